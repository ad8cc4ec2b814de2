"""Source divergences against direct counting, and the perfect hash against a dictionary."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from factorloom.llm import source_divergence
from factorloom.llm.perfect_hash import PerfectHash

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top=10):
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in [tuple(x or "" for x in r) for r in rows]:
        terms = TERM.findall(text.translate(UPPER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in names}
        q = share(sum((counts[lang, s] for s in names), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in names if o != s]
            marks = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(marks)[:top])]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "y", 0.5) for r in rows], "lang string, source string, text string, n long, term string, rank double")


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeÄßé漢"), rng.integers(1, 5))) for _ in range(160)]
    rows = []
    for _ in range(n):
        lang, source = str(rng.choice(["en", "en", "de", "x\0y", "x"])), f"s{int(rng.zipf(1.5)) % 9}"
        chosen = rng.choice(words, rng.integers(0, 30), p=np.arange(160, 0, -1) / (160 * 161 / 2))
        rows.append((lang, source, "".join(w + str(rng.choice([" ", ", ", "1", "\n"])) for w in chosen)))
    return rows


def test_equals_direct_counts(spark):
    rows = corpus(1, 400) + [
        ("en", "quiet", ""), ("en", "quiet2", None), ("en", None, "abc Abc ABC"), (None, "s1", "abc"), (None, "s2", "abc"),
        ("silent", "a", "once"), ("silent", "b", None), ("silent", "c", "12 34"), ("lone", "a", "word"),
        ("en", "é", "Éa éa"), ("en", "long", "abc " * 40_000),
    ]
    rows += rows[:60]
    df = frame(spark, rows)
    want = brute(rows, 5)
    assert found(source_divergence.audit(df.repartition(6), 5)) == want
    # Many shards, and several tiles of sources a language.
    assert found(source_divergence.audit(df, 5, shard_keys=16, tile=2)) == want
    # Workers that keep one shard and send their counts on after every stretch of text.
    assert found(source_divergence.audit(df, 5, shard_keys=16, cache_bytes=1, dense_bytes=1)) == want


def test_fewer_documents_and_an_empty_table(spark):
    rows = corpus(2, 60)
    assert found(source_divergence.audit(frame(spark, rows), 1, top=3)) == brute(rows, 1, 3)
    assert found(source_divergence.audit(frame(spark, rows), 1000)) == brute(rows, 1000)
    assert source_divergence.audit(frame(spark, rows).filter("false")).collect() == []


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**12, 8 * 10**15], np.int64)
    total, terms = int(counts.sum()) + 7, 11
    want = [1 + 1_000_000_000 * (int(c) + 2) // (total + 2 * terms) for c in counts]
    assert source_divergence.shares(counts, total, terms).tolist() == want


def keys_of(values):
    return pa.array(values, pa.large_binary())


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=200), st.sets(st.binary(max_size=6), max_size=50), st.integers(1, 400))
def test_perfect_hash(stored, asked, spread):
    # A narrow hash makes different keys share one.
    hashed = lambda ks: np.array([hash(k) % spread for k in ks], np.uint64)
    keys = sorted(stored)
    table = PerfectHash.frombytes(PerfectHash.build(hashed(keys), keys_of(keys)).tobytes())
    slots = table.slots(hashed(keys), keys_of(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert [table.keys[int(s)].as_py() for s in slots] == keys
    others = sorted(asked)
    assert all((s >= 0) == (k in stored) for s, k in zip(table.slots(hashed(others), keys_of(others)).tolist(), others))


def test_different_hashes_all_get_a_bit():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    table = PerfectHash.build(hashes, keys_of([b"%d" % i for i in range(5000)]))
    assert len(table.listed) == 0 and table.bits.sum() == 5000
