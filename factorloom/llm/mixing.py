"""Mixing sources to target weights by drawing fixed-length blocks of words.

The words of a source form one stream, cut into blocks of BLOCK words.  A target is a number of
blocks.  Every output shard draws the sources of its slots from one multinomial; the draws' surplus
over the targets is taken evenly from all shards and refilled from the sources that came short, so
the totals are the targets.  The k-th slot of a source goes to pass k div n over its n blocks, and in
that pass to place k mod n of a pseudorandom permutation; joined on (source, pass, place), slots and
permutation say how often each block is taken.

Only hashes of row contents and indexes decide, so reruns agree.  A null source is a source of its
own and comes last.  A null text has no words.  Rows without words are kept with `taken` 0.  Repeated
rows count as often as they occur.  A very long text is as many blocks as its words fill.  Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factorloom.operators.blocks import running

from .common import SPACE, WORD, frozen
from .native import BLANKS, prefix_sums, words

BLOCK = 64
SHARD_SLOTS = 8192
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Groups into which one source's documents or permuted blocks are dealt by hash.
GROUPS_LOG2 = 10
#: Cells of the lookup that finds the interval of an index.
CELLS = 4096
#: Shards per group when slots are numbered.
SHARD_GROUP = 4096


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """One row per source: source, rank (by code point, null last), source_size, target.

    `weights` repeat along the rank and divide `share` times all words; a source stops at `most` times
    its words and the excess is shared again by weight.  Each round sends three numbers to the driver.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = by_source.withColumns({"last": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    ranked = running(last, [], ["last", "name"], sums={"rank": F.lit(1).cast("long")}, split=True)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighted = frozen(
        ranked.select(
            "source",
            (F.col("rank") - 1).alias("rank"),
            "source_size",
            F.element_at(pattern, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        )
    )
    most_of = F.col("source_size") * F.lit(float(most))
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped_before = 0.0, -1
    while True:
        capped = most_of < F.col("weight") * level
        taken, free, n = weighted.agg(
            F.sum(F.when(capped, most_of).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
            F.sum(capped.cast("int")),
        ).first()
        if n in (None, capped_before):
            break
        capped_before = n
        if not free:
            break
        level = (total - taken) / free
    return weighted.select(
        "source", "rank", "source_size", F.least(most_of, F.col("weight") * level).alias("target")
    )


def _located(indexes: DataFrame, index: str, intervals: DataFrame, total: int, kept: list[str]) -> DataFrame:
    """Join each index in [0, total) with the interval [low, high) that holds it.

    Intervals are listed under every cell that they touch, so this is an equality join on the cell
    with as many listed rows as cells and intervals together.
    """
    width = max(1, -(-total // CELLS))
    cell = F.floor(F.col(index) / width)
    listed = (
        intervals.filter("low < high")
        .withColumn("__cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
        .select("__cell", "low", "high", *kept)
    )
    return (
        indexes.withColumn("__cell", cell)
        .join(listed, "__cell")
        .filter((F.col(index) >= F.col("low")) & (F.col(index) < F.col("high")))
        .drop("__cell")
    )


def _numbered(df: DataFrame, length: Column) -> DataFrame:
    """Give every row an interval [low, high) of `length`, end to end in rank order."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__n", length).withColumn("high", F.sum("__n").over(w)).withColumn(
        "low", F.col("high") - F.col("__n")
    ).drop("__n")


def shard_counts(quotas: DataFrame, total: int, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots of each source in each shard (shard, rank, n): multinomial draws, then evened to the quotas."""
    spark = quotas.sparkSession
    intervals = _numbered(quotas, F.col("quota"))
    draws = spark.range(total).select(
        F.floor(F.col("id") / shard_slots).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(total)).alias("u"),
    )
    drawn = frozen(
        _located(draws, "u", intervals, total, ["rank"]).groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("drawn"))
    )
    sums = drawn.groupBy("rank").agg(F.sum("drawn").alias("all_drawn"))
    balance = frozen(
        quotas.join(sums, "rank", "left").select(
            "rank", "quota", F.coalesce("all_drawn", F.lit(0)).alias("all_drawn")
        )
    )
    group = F.floor(F.col("shard") / SHARD_GROUP)
    placed = prefix_sums(drawn, ["rank"], group, ["shard"], {"before": F.col("drawn")}).join(balance, "rank")

    def kept_until(n: Column) -> Column:
        share = F.floor(n.cast("double") * F.col("quota") / F.col("all_drawn"))
        return F.when(n == F.col("all_drawn"), F.col("quota")).otherwise(F.least(share, F.col("quota")))

    even = placed.withColumn(
        "kept",
        F.when(F.col("all_drawn") <= F.col("quota"), F.col("drawn")).otherwise(
            kept_until(F.col("before") + F.col("drawn")) - kept_until(F.col("before"))
        ),
    )
    kept = frozen(even.select("shard", "rank", "drawn", "kept"))
    # Places given up, numbered over all shards, go to the sources that came short.
    open_places = kept.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("open")).filter("open > 0")
    short = _numbered(
        balance.filter("quota > all_drawn").select("rank", (F.col("quota") - F.col("all_drawn")).alias("short")),
        F.col("short"),
    )
    missing = short.agg(F.sum("short")).first()[0] or 0
    if not missing:
        return kept.select("shard", "rank", F.col("kept").alias("n"))
    one_key = open_places.withColumn("all", F.lit(0))
    numbered = prefix_sums(one_key, ["all"], group, ["shard"], {"first": F.col("open")}).select(
        "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("open") - 1)).alias("place")
    )
    # A multiplier without a common factor with `missing` spreads the short sources over the shards.
    step = next(p for p in (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081) if missing % p)
    dealt = numbered.withColumn("y", F.pmod(F.col("place") * step, F.lit(missing)))
    refill = _located(dealt, "y", short, missing, ["rank"]).groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))
    both = kept.select("shard", "rank", F.col("kept").alias("n")).unionByName(refill)
    return both.groupBy("shard", "rank").agg(F.sum("n").alias("n")).filter("n > 0")


def block_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = 17,
    block: int = BLOCK,
    extra: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents with their place in the source's stream, targets, and how often blocks are taken.

    Returns (documents: doc_id, rank, size, begin and `extra`; targets; taken: rank, block, times).
    """
    text = F.col(text_column).cast("string")
    extra = extra or {}
    sized = frozen(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            F.size(words(text)).cast("long").alias("size"),
            F.xxhash64(text).alias("content"),
            *[c.alias(n) for n, c in extra.items()],
        )
    )
    targets = frozen(source_targets(sized))
    ranked = sized.join(
        targets.select(F.col("source").alias("__source"), "rank"), F.col("source").eqNullSafe(F.col("__source"))
    ).drop("__source", "source")
    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "content"), F.lit(1 << GROUPS_LOG2))
    placed = prefix_sums(ranked, ["rank"], dealt, ["doc_id", "content", "size"], {"begin": F.col("size")})

    n_blocks = F.ceil(F.col("source_size") / block)
    mean = F.col("source_size") / n_blocks
    quotas = frozen(
        targets.filter("source_size > 0").select(
            "rank",
            n_blocks.alias("n_blocks"),
            F.least(F.round(F.col("target") / mean).cast("long"), 2 * n_blocks).alias("quota"),
        )
    )
    total, blocks = quotas.agg(F.sum("quota"), F.sum("n_blocks")).first()
    if not total:
        nothing = quotas.select("rank", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("times"))
        return frozen(placed), targets, nothing.limit(0)

    counts = shard_counts(quotas.select("rank", "quota"), total, seed)
    group = F.floor(F.col("shard") / SHARD_GROUP)
    slots = (
        prefix_sums(counts, ["rank"], group, ["shard"], {"first": F.col("n")})
        .select("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
        .join(quotas.select("rank", "n_blocks"), "rank")
        .select("rank", F.floor(F.col("slot") / F.col("n_blocks")).alias("pass"), F.pmod("slot", "n_blocks").alias("place"))
    )
    every_block = _located(
        docs.sparkSession.range(blocks), "id", _numbered(quotas, F.col("n_blocks")), blocks, ["rank", "n_blocks", "quota"]
    ).select("rank", "n_blocks", "quota", (F.col("id") - F.col("low")).alias("block"))
    passes = every_block.withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("n_blocks"))))
    ).filter("quota > 0")
    keyed = passes.withColumn("key", F.xxhash64(F.lit(seed), F.lit("order"), "rank", "pass", "block"))
    permutation = prefix_sums(
        keyed, ["rank", "pass"], F.shiftright("key", 64 - GROUPS_LOG2), ["key", "block"], {"place": F.lit(1).cast("long")}
    ).select("rank", "pass", "place", "block")
    taken = (
        slots.join(permutation, ["rank", "pass", "place"])
        .groupBy("rank", "block")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return frozen(placed), targets, frozen(taken)


def document_blocks(placed: DataFrame, taken: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block that it has words in: its columns, first_word, n_words, times."""
    at = F.col("block") * block
    spread = placed.filter("size > 0").withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))),
    )
    begin, end = F.greatest(at, F.col("begin")), F.least(at + block, F.col("begin") + F.col("size"))
    return (
        spread.withColumns({"first_word": begin - F.col("begin"), "n_words": end - begin})
        .join(taken, ["rank", "block"], "left")
        .withColumn("times", F.coalesce("times", F.lit(0)))
    )


def mix(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    placed, targets, taken = block_plan(docs, **columns)
    counted = (
        document_blocks(placed, taken)
        .groupBy("rank", "begin", "doc_id", "size")
        .agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    )
    wordless = placed.filter("size = 0").select("rank", "begin", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return (
        counted.unionByName(wordless)
        .join(targets.select("rank", "source_size", "target"), "rank")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 17
) -> DataFrame:
    """The mix itself, with the columns of `docs`: each row holds the words that one pass takes of a text.

    A text taken whole stays as it is; of others the taken runs of words are joined in order with
    the white space that follows them.  `n_chars`, where there is such a column, is counted again.
    """
    tagged = frozen(docs.withColumn("__row", F.monotonically_increasing_id()))
    placed, _, taken = block_plan(
        tagged, id_column, text_column, source_column, seed, extra={"row": F.col("__row")}
    )
    parts = (
        document_blocks(placed, taken)
        .filter("times > 0")
        .groupBy(F.col("row").alias("__row"), F.col("size").alias("__size"))
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words", "times"))).alias("__parts"))
    )
    passes = F.array_max(F.transform("__parts", lambda p: p["times"]))
    repeated = tagged.join(parts, "__row").withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    own = F.filter("__parts", lambda p: p["times"] >= F.col("__pass"))
    chosen = repeated.withColumn("__parts", own)
    text = F.col(text_column).cast("string")
    units = F.regexp_extract_all(text, F.lit(f"{WORD}(?:{SPACE})?"), F.lit(0))
    cut = chosen.withColumn("__units", F.when(_words_of("__parts") < F.col("__size"), units))
    runs = F.transform(
        "__parts",
        lambda p: F.slice(F.col("__units"), (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")),
    )
    joined = F.btrim(F.array_join(F.flatten(runs), ""), F.lit(BLANKS))
    out = cut.withColumn(text_column, F.coalesce(joined, text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_column).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _words_of(parts: str) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["n_words"])
