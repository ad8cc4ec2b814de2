"""Toxicity learner and language model: held-out accuracy and exact recomputation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import kneser_ney, toxicity
from factorloom.llm.common import Texts

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- toxicity -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    neutral = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(800)]
    bad = [f"vil{e}" for e in ("ea", "iest", "ox", "anu", "ic", "ard")] + ["Grubb,"]
    docs, labels = [], []
    for i in range(1500):
        words = list(rng.choice(neutral, rng.integers(5, 120)))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.integers(1, 6)):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    truth = {i: any(w in bad for w in t.split()) for i, t in docs}
    docs += [(2001, None), (2002, ""), (None, "grubb null id"), (3, docs[3][1]), (2003, "nothing 123 !!"), (2004, "é " * 9000 + "grubb")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "words": F.lit(1)})
    return df, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"), truth


def test_held_out_toxic_texts_are_found(corpus):
    docs, labels, truth = corpus
    model = toxicity.train(docs, labels)
    rows = docs.select("doc_id", "text", toxicity.held_out().alias("out"), model.score(F.col("text")).alias("p")).collect()
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.p <= 1 for r in rows)
    judged = [(truth[r.doc_id], r.p >= toxicity.THRESHOLD) for r in rows if r.out and r.doc_id in truth]
    hits = sum(t and p for t, p in judged)
    assert hits >= 0.97 * sum(t for t, _ in judged)
    assert sum(p and not t for t, p in judged) <= 2
    by_id = {r.doc_id: r.p for r in rows}
    assert by_id[2001] == by_id[2002] == by_id[2003] < toxicity.THRESHOLD <= min(by_id[None], by_id[2004])


def test_scores_repeat(corpus):
    docs, labels, _ = corpus
    scores = []
    for df in (docs, docs.repartition(7)):
        model = toxicity.train(df, labels)
        scores.append(sorted((str(r.doc_id), r.p) for r in df.select("doc_id", model.score(F.col("text")).alias("p")).collect()))
    assert scores[0] == scores[1]


def test_non_negative_risk_uses_the_prior():
    # Half of the unlabelled texts are positives in hiding; only the prior tells them from negatives.
    word = lambda *w: np.sort(np.array(w, np.uint64)).tobytes()
    positive = [word(1, 10 + k % 5) for k in range(200)]
    unlabelled = [word(1, 10 + k % 5) if k < 60 else word(10 + k % 5) for k in range(400)]
    words, weights, intercept = toxicity.fit(positive, unlabelled, 0.15)
    assert words.tolist() == [1]
    p = 1 / (1 + np.exp(-(weights[0] + intercept)))
    assert p > 0.9 and 1 / (1 + np.exp(-intercept)) < 0.1


def test_without_confirmed_toxic_texts_all_scores_are_zero(spark, corpus):
    docs, labels, _ = corpus
    model = toxicity.train(docs, labels.filter("toxic = 0"))
    assert docs.select(model.score(F.col("text")).alias("p")).filter("p <> 0").count() == 0
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert empty.scores(Texts(pa.array(["a", None]))).tolist() == [0, 0]


# --- language model -----------------------------------------------------------------------------


class Plain:
    """Modified Kneser-Ney by dictionaries, straight from its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.raw = [Counter() for _ in range(order + 1)]
        for text in texts:
            tokens = ["<s>", *self.tokens(text)]
            for k in range(1, order + 1):
                for i in range(len(tokens) - k + 1):
                    self.raw[k][tuple(tokens[i : i + k])] += 1
        self.words = Counter({g[0]: c for g, c in self.raw[1].items() if g != ("<s>",)})
        self.adjusted = [None] * (order + 1)
        self.adjusted[order] = dict(self.raw[order])
        for k in range(order - 1, 0, -1):
            before = defaultdict(set)
            for g in self.raw[k + 1]:
                before[g[1:]].add(g[0])
            self.adjusted[k] = {g: len(before[g]) or c for g, c in self.raw[k].items()}
        self.adjusted[1].pop(("<s>",), None)
        self.d = [None] * (order + 1)
        for k in range(1, order + 1):
            of = Counter(self.adjusted[k].values())
            self.d[k] = (0.0, *kneser_ney.discounts(*(of[n] for n in (1, 2, 3, 4))))
        self.by_context = [defaultdict(list) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.adjusted[k].items():
                self.by_context[k][g[:-1]].append(c)

    @staticmethod
    def tokens(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*WORD.findall(low), "</s>"]

    def p(self, word, context):
        k = len(context) + 1
        lower = self.p(word, context[1:]) if k > 1 else 1 / (len(self.words) + 1)
        counts = self.by_context[k].get(context)
        if not counts:
            return lower
        total = sum(counts)
        c = self.adjusted[k].get((*context, word), 0)
        free = sum(self.d[k][min(x, 3)] for x in counts)
        return (c - self.d[k][min(c, 3)]) / total + free / total * lower

    def score(self, text):
        tokens, total = ["<s>", *self.tokens(text)], 0.0
        for i in range(1, len(tokens)):
            total += math.log10(self.p(tokens[i], tuple(tokens[max(0, i - self.order + 1) : i])))
        return total


@pytest.fixture(scope="module")
def sentences(spark):
    rng = np.random.default_rng(4)
    words = ["the", "The", "cat", "dog", "sat", "ran", "on", "a", "mat", "é", "xy.", "日本"]
    weight = 1 / np.arange(1, 13)
    texts = [" ".join(rng.choice(words, rng.integers(0, 25), p=weight / weight.sum())) for _ in range(150)]
    rows = list(enumerate(texts)) + [(200, None), (201, "  \n "), (202, "new words ÉÀ only"), (7, texts[7]), (None, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "run": F.lit("x")})
    return df.repartition(3), rows


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_model_equals_the_definition(sentences, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "RUN_TOKENS", 100)
    df, rows = sentences
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    plain = Plain(train, order)
    model = kneser_ney.train(df, order, shards=4)
    got = kneser_ney.score(df, model).collect()
    n = sum(plain.words.values())
    want = sorted(
        (
            len(plain.tokens(t)),
            sum(w in plain.words for w in plain.tokens(t)),
            round(sum(math.log10((plain.words[w] + 1) / (n + len(plain.words) + 1)) for w in plain.tokens(t)), 4),
            round(plain.score(t), 4),
        )
        for _, t in rows
    )
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    vocabulary = [*plain.words, "unseen"]
    for context in ((), ("<s>",), ("the",), ("cat", "the")):
        if len(context) < order:
            assert sum(plain.p(w, context) for w in vocabulary) == pytest.approx(1)


def test_model_without_training_rows(sentences):
    df, _ = sentences
    rows = kneser_ney.score(df, kneser_ney.train(df.limit(0), 2)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)
    assert kneser_ney.score(df.limit(0), kneser_ney.train(df, 2)).count() == 0
