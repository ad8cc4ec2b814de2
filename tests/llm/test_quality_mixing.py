"""Quality rules and mixing against plain Python on small tables with odd rows."""

import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from factorloom.llm import mixing, quality

WORD = re.compile("[^\x20\x09-\x0d]+")

TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "\x0b one  two\r\nthree \x0c",
    "a b c d e f g h " * 3,
    "x " + "a b c d e f g h i " * 2 + "y",
    "line one\nline one\n\n \nline two \nline two\n" + "word " * 30,
    "né 日本 #tag 50% $5 <b> | & * " * 5 + "end",
    " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(100, 130)),
    "same " * 2000,
    "e m sp ace kept " * 10,
]


def hashed(word):
    return xxhash.xxh64_intdigest(word.encode(), 42)


def joined(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)
    return xxhash.xxh64_intdigest(struct.pack("<Q", b), first)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def expected_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def grams(text):
    h = [hashed(w) for w in WORD.findall(text or "")]
    return [signed(x) % quality.BUCKETS for x in h + [joined(a, b) for a, b in zip(h, h[1:])]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "null id " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_words": F.lit("clash"), "kept": F.lit(1), "size": F.lit(None).cast("int")}).repartition(3)


def test_quality_against_brute_force(spark, docs):
    trusted_ids = [3, 8, 9, 11, 9, None, 999]
    labels = spark.createDataFrame([(i, 1) for i in trusted_ids] + [(5, 0), (10, None)], "doc_id long, quality int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    raw, target = Counter(), Counter()
    for doc_id, text in rows:
        own = grams(text)
        raw.update(own)
        if doc_id in {3, 8, 9, 11}:
            target.update(own)
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: float(f"{math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR)):.6g}") for b in raw}
    ratios = quality.bucket_ratios(docs, quality.trusted(labels))
    got = quality.judge(docs.select("doc_id", "text"), ratios).select("doc_id", "text", "__quality.*").collect()
    assert len(got) == len(rows)
    for r in got:
        base = expected_base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, r.text
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert r.base_failed == failed
        if base[0]:
            llr = sum(ratio[b] for b in grams(r.text)) / base[0]
            assert r.llr == pytest.approx(llr, abs=1e-12)
            assert r.kept == (not failed and llr >= quality.THRESHOLD)
        else:
            assert r.llr is None and not r.kept


def test_quality_by_shuffled_ids_is_the_same(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(8,), (9,)], "doc_id long")
    small = quality.bucket_ratios(docs, labels)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert quality.bucket_ratios(docs, labels) == small


def test_quality_without_trusted_or_any_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.bucket_ratios(docs, none) is None
    rows = quality.judge(docs.select("doc_id", "text"), None).select("__quality.*").collect()
    assert all(r.llr is None and r.kept == (not r.base_failed) for r in rows)
    assert quality.judge(docs.limit(0), [0.0] * quality.BUCKETS).count() == 0


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


@pytest.fixture(scope="module")
def mixed(spark):
    rows, n = [], 0
    for source, many, words in (("b", 60, 90), ("a", 3, 10), (None, 20, 300), ("é", 10, 500), ("c", 40, 1), ("z", 1, 9000)):
        for k in range(many):
            rows.append((n, " ".join(f"{source}{n}w{i}" for i in range(words + k)), source))
            n += 1
    rows += [(n, None, "b"), (n + 1, "", "empty"), (None, "no id " * 40, "b"), (0, rows[0][1], "b"), (0, rows[0][1], "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(4)


def test_mix_comes_near_its_targets(mixed):
    rows = mixing.mix(mixed).collect()
    again = mixing.mix(mixed.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    texts = [(r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in mixed.collect()]
    sizes = defaultdict(int)
    for _, n, source in texts:
        sizes[source] += n
    targets = expected_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), n) for i, n, _ in texts)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        source = [s for s in sizes if sizes[s] == r.source_size]
        assert source and any(abs(targets[s] - r.target) < 1e-6 for s in source)
        taken[r.source_size, r.target] += r.taken
    for (size, target), words in taken.items():
        assert abs(words - target) <= max(1.5 * mixing.BLOCK, 0.01 * target)


def test_mixed_texts_hold_the_words_that_the_mix_takes(mixed):
    whole = mixing.mix(mixed)
    parts = mixing.mixed_texts(mixed)
    assert parts.columns == mixed.columns
    count = lambda df: {(r.doc_id): r.n for r in df.collect()}
    want = count(whole.groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0"))
    rows = parts.collect()
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert got == want
    texts = {r.doc_id: WORD.findall(r.text or "") for r in mixed.collect()}
    for r in rows:
        own, left = WORD.findall(r.text), iter(texts[r.doc_id])
        assert all(w in left for w in own)  # in the order of the text


def test_draws_follow_the_weights_in_every_shard(spark):
    quotas = spark.createDataFrame([(0, 3000), (1, 1000), (2, 96)], "rank long, quota long")
    rows = mixing.shard_counts(quotas, 4096, 3, shard_slots=512).collect()
    totals, shards = defaultdict(int), defaultdict(int)
    for r in rows:
        totals[r.rank] += r.n
        shards[r.shard] += r.n
        if r.rank == 0:
            assert abs(r.n - 375) < 5 * math.sqrt(512 * 0.73 * 0.27)
    assert dict(totals) == {0: 3000, 1: 1000, 2: 96}
    assert set(shards.values()) == {512}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (1, "", "a")]])
def test_mix_without_words(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).collect()
    assert len(found) == len(rows) and all((r.size, r.taken, r.target) == (0, 0, 0.0) for r in found)
    assert mixing.mixed_texts(df).count() == 0
