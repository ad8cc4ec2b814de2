"""Quality rules: counts over whole texts and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS buckets.  Two multinomials over the buckets, one of the
trusted documents and one of all documents, give each bucket a log ratio; a document's score is the
sum over its words and pairs, divided by its number of words.  It is kept at THRESHOLD or above.

A null or empty text has no words and fails the base rules.  Without a trusted document there is no
ratio: the score is null and the base rules alone decide.  Labels are matched on the id; repeated
rows count as often as they occur; a very long text is judged whole, as one row; other columns pass through.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from .native import BLANKS, words

BUCKETS = 1 << 14
THRESHOLD = -0.06
#: Added to both counts of a bucket: a ratio rests on this many expected trusted occurrences before
#: it can move far from 0, so rare words count as little in a small corpus as in a large one.
PRIOR = 100.0
MIN_WORDS = 20
MAX_REPEATED = 30
RUN = 8
SYMBOLS = "#*$%&|<>"
#: Ids up to this many go to every executor (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000

SCRATCH = ("__words", "__hashes", "__buckets", "__runs", "__base")


def _doubled(hashes: Column, reach: int) -> Column:
    """Hash of the runs of 2 * reach words, from the hashes of runs of `reach` words."""
    n = F.size(hashes) - reach
    later = F.slice(hashes, F.lit(reach + 1), F.greatest(n, F.lit(0)))
    joined = F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))
    return F.slice(joined, F.lit(1), F.greatest(n, F.lit(0)))


def repeated_words(runs: Column, run: int = RUN) -> Column:
    """Words that lie in a run of `run` words that the text holds twice or more.

    Sorting (hash, place) brings equal runs together; the covered words are counted over the places
    in order, each adding the part of its run that lies before the next place.
    """
    pairs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    blank = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(blank, F.slice(pairs, F.lit(1), F.size(runs) - 1))
    after = F.concat(F.slice(pairs, F.lit(2), F.size(runs) - 1), blank)
    marked = F.zip_with(
        F.zip_with(pairs, before, lambda a, b: F.struct(a.alias("own"), (a["h"] == b["h"]).alias("same"))),
        after,
        lambda a, b: F.struct(
            a["own"]["i"].alias("i"),
            (F.coalesce(a["same"], F.lit(False)) | F.coalesce(a["own"]["h"] == b["h"], F.lit(False))).alias("twice"),
        ),
    )
    places = F.sort_array(F.transform(F.filter(marked, lambda m: m["twice"]), lambda m: m["i"]))
    counted = F.aggregate(
        places,
        F.struct(F.lit(-run).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(run))).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("long")).otherwise(counted)


def with_base(docs: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Append scratch columns: words' buckets and a struct of the base counts."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    hashed = docs.withColumn("__words", words(text)).withColumn(
        "__hashes", F.transform("__words", lambda w: F.xxhash64(w))
    )
    pairs = hashed.withColumn("__runs", _doubled(F.col("__hashes"), 1))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    listed = pairs.withColumn("__buckets", F.transform(F.concat("__hashes", "__runs"), bucket))
    eight = listed.withColumn("__runs", _doubled(F.col("__runs"), 2)).withColumn(
        "__runs", _doubled(F.col("__runs"), 4)
    )
    plain = F.char_length(text)
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    base = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (plain - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__runs")).alias("n_repeat_words"),
    )
    return eight.withColumn("__base", base).drop("__words", "__hashes", "__runs")


def bucket_ratios(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
) -> list[float] | None:
    """Log ratio of each bucket to six digits; None without trusted words.

    The count among trusted documents is held against the one that the raw multinomial expects there.
    All documents are counted.  The driver gets one row per bucket.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("__trusted")).filter("__trusted IS NOT NULL").distinct()
    if trusted_ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    slim = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("text"))
    flagged = slim.join(ids, F.col("__id") == F.col("__trusted"), "left").select(
        F.col("__trusted").isNotNull().cast("long").alias("trusted"), words(F.col("text")).alias("__words")
    )
    hashed = flagged.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))).drop("__words")
    both = F.concat("__hashes", _doubled(F.col("__hashes"), 1))
    counts = (
        hashed.select("trusted", F.explode(both).alias("h"))
        .groupBy(F.pmod("h", F.lit(buckets)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for row in counts.collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not sum(target):
        return None
    share = sum(target) / sum(raw)
    return [float(f"{log((t + PRIOR) / (r * share + PRIOR)):.6g}") for t, r in zip(target, raw)]


def judge(
    docs: DataFrame,
    ratios: list[float] | None,
    text_column: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Append `__quality`, a struct of the base counts, base_failed, llr and kept.  No shuffle."""
    scored = with_base(docs, text_column, buckets)
    n = F.col("__base.n_words")
    if ratios is None:
        llr = F.lit(None).cast("double")
    else:
        # One literal array; the text form keeps the plan's construction to a single call.
        table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
        summed = F.aggregate("__buckets", F.lit(0.0), lambda total, b: total + F.get(table, b))
        llr = F.when(n > 0, summed / n)
    failed = (n < MIN_WORDS) | (100 * F.col("__base.n_repeat_words") > MAX_REPEATED * n)
    judged = scored.withColumn("__llr", llr).withColumn(
        "__quality",
        F.struct(
            "__base.*",
            failed.alias("base_failed"),
            F.col("__llr").alias("llr"),
            (~failed & F.coalesce(F.col("__llr") >= threshold, F.lit(True))).alias("kept"),
        ),
    )
    return judged.drop("__base", "__buckets", "__llr")


def keep_good(judged: DataFrame) -> DataFrame:
    """The kept rows of `judge`, without its column.

    A filter on the plain column would be pushed below the projections, which would then repeat their
    expressions in the condition, once for every use; a part that isn't deterministic pins it above.
    """
    pinned = F.col("__quality.kept") & (F.monotonically_increasing_id() >= 0)
    return judged.withColumn("__keep", pinned).filter("__keep").drop("__keep", "__quality")


def trusted(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")
