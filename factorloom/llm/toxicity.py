"""Toxicity scores by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and a sample of all training texts without labels.  With the
class prior p the risk of a scorer g under the loss l is

    p E_pos[l(g)] + max(0, E_all[l(-g)] - p E_pos[l(-g)]),

and where the second part falls below 0 the step goes against its gradient (non-negative
correction).  Several numpy classifiers, each with an own part of the unlabelled sample, are trained
in tasks of their own; a text's score is the mean of their probabilities.

Features are the distinct words of a text (runs of letters, A-Z lowered) and their first STEMS bytes,
as far as the positive sample holds them clearly more often than the unlabelled one.  The sample is bounded by
MOST_POSITIVE and MOST_UNLABELLED texts, taken by a hash of the id; every text is scored whole.

A null or empty text has no features and gets the score of the intercept.  Without a confirmed toxic
text every score is 0.  A null id is never held out nor labelled.  Repeated rows count once in the
sample and are scored each.  A very long text is taken alone and scored whole.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SpanHashes, Texts, frozen, letters, lowered, text_batches

MOST_POSITIVE = 20_000
MOST_UNLABELLED = 30_000
MEMBERS = 3
MOST_FEATURES = 2048
THRESHOLD = 0.7
STEMS = (4, 5, 6)
#: A feature's rate among positives over its rate among all texts, and that log ratio's z value.
LEAST_RATIO, LEAST_Z = 2.5, 3.0


@dataclass(frozen=True)
class Model:
    """Sorted word hashes, the members' weights (members x words) and intercepts."""

    words: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray

    def scores(self, texts: Texts) -> np.ndarray:
        doc, word = matches(texts, self.words)
        logits = np.stack([np.bincount(doc, weights=w[word], minlength=len(texts)) for w in self.weights])
        with np.errstate(over="ignore"):
            return (1 / (1 + np.exp(-logits - self.intercepts[:, None]))).mean(0)

    def score(self, text: Column) -> Column:
        """Score column of a text column; works in any projection."""

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                whole = pa.RecordBatch.from_arrays([column], names=["text"])
                parts = [self.scores(texts) for _, texts in text_batches(iter([whole]), "text")]
                yield pa.array(np.concatenate([np.zeros(0), *parts]))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "double")(text.cast("string"))


def _hashed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word and of the beginnings of longer words."""
    buf = lowered(texts.buf)
    starts, ends, owner = texts.words(letters(buf))
    spans = SpanHashes(buf)
    owners, hashes = [owner], [spans.of(starts, ends)]
    for n in STEMS:
        longer = ends - starts > n
        owners.append(owner[longer])
        hashes.append(~spans.of(starts[longer], starts[longer] + n))
    return np.concatenate(owners), np.concatenate(hashes)


def matches(texts: Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, place in `words`) pairs."""
    if not len(words) or not len(texts.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, h = _hashed(texts)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    pairs = np.unique(owner[hit] * len(words) + at[hit])
    return pairs // len(words), pairs % len(words)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the id's CRC-32 leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, float]:
    """Bounded training sample (positive, fold, words: sorted distinct hashes) and the class prior.

    The prior is the toxic share of the labelled training rows.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out("doc_id"))
    toxic, labelled = usable.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count(F.lit(1))).first()
    toxic = toxic or 0
    prior = toxic / labelled if labelled else 0.0
    # So fine that no number of documents rounds a share to nothing.
    steps = 1 << 62
    dealt = lambda c: F.pmod(F.xxhash64(F.lit("toxicity sample"), c), F.lit(steps))
    positive = (
        usable.filter("toxic = 1")
        .filter(dealt(F.col("doc_id")) < min(steps, steps * MOST_POSITIVE // max(toxic, 1)))
        .select(F.col("doc_id").alias("__id"))
        .distinct()
    )
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).filter(
        ~held_out("doc_id")
    )
    share = min(steps, steps * MOST_UNLABELLED // max(docs.count(), 1))
    chosen = (
        # At most about MOST_POSITIVE ids.
        slim.join(F.broadcast(positive), F.col("doc_id") == F.col("__id"), "left")
        .select(
            F.col("__id").isNotNull().alias("positive"),
            (dealt(F.col("doc_id")) < share).alias("unlabelled"),
            F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(MEMBERS)).cast("int").alias("fold"),
            "text",
        )
        .filter("positive OR unlabelled")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            owner, h = _hashed(texts)
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            owner, h = owner[new], h[new]
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            lists = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(lists, pa.binary())], names=["positive", "unlabelled", "fold", "words"]
            )

    rows = chosen.mapInArrow(extract, "positive boolean, unlabelled boolean, fold int, words binary")
    distinct = rows.groupBy("words").agg(
        F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"), F.min("fold").alias("fold")
    )
    return frozen(distinct), prior


def _document_counts(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(lists), np.uint64)
    return np.unique(flat, return_counts=True)


def select_words(positive: list[bytes], unlabelled: list[bytes]) -> np.ndarray:
    """Sorted hashes of the words that mark positives best by the z value of the log rate ratio."""
    words, n_positive = _document_counts(positive)
    others, counts = _document_counts(unlabelled)
    at = np.minimum(np.searchsorted(others, words), max(len(others) - 1, 0))
    n_all = np.where(others[at] == words, counts[at], 0) if len(others) else np.zeros(len(words))
    ratio = ((n_positive + 0.5) / (len(positive) + 1)) / ((n_all + 0.5) / (len(unlabelled) + 1))
    z = np.log(ratio) / np.sqrt(1 / (n_positive + 0.5) + 1 / (n_all + 0.5))
    good = np.flatnonzero((ratio >= LEAST_RATIO) & (z >= LEAST_Z) & (n_positive > 1))
    best = good[np.argsort(-z[good], kind="stable")[:MOST_FEATURES]]
    return np.sort(words[best])


def fit(
    positive: list[bytes], unlabelled: list[bytes], prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4
) -> tuple[np.ndarray, np.ndarray, float]:
    """One classifier: word hashes, weights, intercept; full-batch Adam on the non-negative risk."""
    words = select_words(positive, unlabelled)

    def presence(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(lists), np.uint64)
        owner = np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists])
        if not len(words):
            return owner[:0], owner[:0]
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[at] == flat
        return owner[hit], at[hit]

    p_doc, p_word = presence(positive)
    u_doc, u_word = presence(unlabelled)
    w, b = np.zeros(len(words)), 0.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    softplus = lambda x: np.logaddexp(0, x)

    def back(doc: np.ndarray, word: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(word, weights=slope[doc], minlength=len(words)), slope.sum())

    for step in range(1, steps + 1):
        gp = np.bincount(p_doc, weights=w[p_word], minlength=len(positive)) + b
        gu = np.bincount(u_doc, weights=w[u_word], minlength=len(unlabelled)) + b
        # l(g) = log(1 + exp(-g)): slope of l(g) is s(g) - 1, of l(-g) it is s(g).
        rest = softplus(gu).mean() - prior * softplus(gp).mean()
        down = back(u_doc, u_word, sigmoid(gu) / len(gu)) - back(p_doc, p_word, prior * sigmoid(gp) / len(gp))
        up = back(p_doc, p_word, prior * (sigmoid(gp) - 1) / len(gp))
        slope = up + down if rest >= 0 else -down
        slope[:-1] += l2 * w
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return words, w, float(b)


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> Model:
    """Fit MEMBERS classifiers in tasks of their own; the driver gets MOST_FEATURES weights of each."""
    rows, prior = sample(docs, labels, id_column, text_column)
    empty = Model(np.zeros(0, np.uint64), np.zeros((1, 0)), np.array([-np.inf]))
    if not rows.filter("positive").limit(1).count():
        return empty
    copies = F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(MEMBERS - 1))).otherwise(F.array("fold"))
    # Positives go to every member; an unlabelled text (a positive may be one too) to its fold.
    dealt = rows.withColumn("member", F.explode(copies)).withColumn(
        "unlabelled", F.col("unlabelled") & (F.col("fold") == F.col("member"))
    )

    def member(table: pa.Table) -> pa.Table:
        table = table.sort_by("words")
        words = np.array(table["words"].to_pylist(), object)
        is_positive = table["positive"].to_numpy()
        unlabelled = words[table["unlabelled"].to_numpy()].tolist() or words[is_positive].tolist()
        found, w, b = fit(words[is_positive].tolist(), unlabelled, prior)
        return pa.table(
            {"words": [found.tobytes()], "weights": [w.tobytes()], "intercept": [b]},
            schema=pa.schema([("words", pa.binary()), ("weights", pa.binary()), ("intercept", pa.float64())]),
        )

    fitted = (
        dealt.groupBy("member")
        .applyInArrow(member, "words binary, weights binary, intercept double")
        .collect()
    )
    parts = [(np.frombuffer(r.words, np.uint64), np.frombuffer(r.weights)) for r in fitted]
    words = np.unique(np.concatenate([p[0] for p in parts]))
    weights = np.zeros((len(parts), len(words)))
    for row, (own, w) in zip(weights, parts):
        row[np.searchsorted(words, own)] = w
    return Model(words, weights, np.array([r.intercept for r in fitted]))


def with_scores(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    return docs.withColumn(out, model.score(F.col(text_column)))
