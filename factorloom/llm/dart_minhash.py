"""Near duplicates by DartMinHash signatures of weighted word shingles.

A text is a weighted set: its runs of SHINGLE words, each weighing its number of occurrences.  Darts
are thrown at the plane of weight and time above each shingle, at random but the same for all texts:
the weight axis is cut into the regions [0, 1), [1, 2), [2, 4), [4, 8), ..., and a region of width d
is hit at rate d.  The darts that land below a text's weight are its darts; each is hashed to one of
COORDINATES coordinates, and the earliest per coordinate is the signature.  Two texts agree in a
coordinate with probability sum(min) / sum(max) of their weights.  Darts are generated in order of
time up to a limit that fills all coordinates, which for a long text is early: the work follows the
number of shingles, not its product with the number of coordinates.

Signatures are cut into BANDS of ROWS coordinates; texts that share a band may be similar, and what
such sharing connects is a cluster.  Only clusters are compared, exactly and by their whole shingle
sets: small ones together in one task, large ones in tiles of about TILE shingles, two tiles at a time where
some band has members in both.  A task returns the links of THRESHOLD or more as a spanning forest,
never pairs, and classes are the components of these links.

Texts with the same words are merged before; rows with one id are one document, for which one of its
texts speaks.

A text with fewer than SHINGLE words is one shingle.  A text without words, a null text or a row with
a null id is compared with nothing: its class is its own id and it is kept.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Texts, frozen, mix, span_hashes, spread, text_batches
from .graph import components, forest

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.99993.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Shingles per tile; a text counts as SMALLEST at least, which bounds the texts of a tile.
TILE, SMALLEST = 100_000, 128
#: Shingles that more texts of a tile hold are counted by matrix products, others by their pairs.
DENSE = 32
#: Ids up to this many go to every executor (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: Texts, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text number, hash and weight; and the hash of every text's word sequence."""
    starts, ends, owner = texts.words()
    h = span_hashes(texts.buf, starts, ends)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    content = np.array(
        [hashlib.blake2b(h[a : a + n], digest_size=16).digest() if n else None for a, n in zip(first, count)], object
    )
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at, doc = spread(first, runs), np.repeat(np.arange(len(texts)), runs)
    length = np.minimum(count, width)[doc]
    s = h[at] + length.astype(np.uint64)
    for j in range(1, width):
        more = length > j
        s[more] = mix(s[more] * np.uint64(0x2545F4914F6CDD1D)) + h[at[more] + j]
    s = mix(s)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])))) if len(s) else np.zeros(0, int)
    weight = np.diff(np.append(new, len(s))).astype(float)
    return doc[new], s[new], weight, content


def signatures(
    doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, coordinates: int = COORDINATES, seed: int = 1
) -> np.ndarray:
    """DartMinHash of n weighted sets (sorted rows of set number, element, weight > 0).

    n x coordinates; NEVER in the rows of empty sets.
    """
    table = np.full(n * coordinates, NEVER, np.uint64)
    norm = np.bincount(doc, weights=weight, minlength=n)
    darts = coordinates * (np.log(coordinates) + 3)
    until = np.divide(darts, norm, out=np.zeros(n), where=norm > 0)
    # Regions: number 0 is [0, 1), number v is [2 ** (v - 1), 2 ** v).
    regions = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), regions)
    region = spread(np.zeros(len(doc), np.int64), regions)
    low = np.where(region > 0, 2.0 ** (region - 1), 0.0)
    width = np.where(region > 0, low, 1.0)
    state = mix(element[row] ^ mix(region.astype(np.uint64) + np.uint64(seed << 8)))
    begin, end = np.zeros(n), until
    open_sets = norm > 0
    while open_sets.any():
        live = np.flatnonzero(open_sets[doc[row]])
        time, own, step = np.zeros(len(live)), state[live], 0
        stop = end[doc[row[live]]]
        while len(live):
            step += 1
            own = mix(own + np.uint64(0x9E3779B97F4A7C15))
            gap = -np.log(((own >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            time = time + gap / width[live]
            near = time < stop
            live, time, own, stop = live[near], time[near], own[near], stop[near]
            other = mix(own ^ np.uint64(0xA0761D6478BD642F))
            height = low[live] + width[live] * (other >> np.uint64(11)).astype(float) * 2.0**-53
            hit = height < weight[row[live]]
            slot = doc[row[live[hit]]] * coordinates + (other[hit] % np.uint64(coordinates)).astype(np.int64)
            early = time[hit].astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(table, slot, (early << np.uint64(32)) | (mix(other[hit]) >> np.uint64(32)))
        # Sets with an empty coordinate throw on, until twice the time.
        unfilled = (table.reshape(n, coordinates) == NEVER).any(1) & (norm > 0)
        open_sets, end = unfilled, np.where(unfilled, end * 2, end)
    return table.reshape(n, coordinates)


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """One hash per band of a signature's coordinates."""
    parts = signature.reshape(len(signature), count, -1)
    h = np.broadcast_to(mix(np.arange(1, count + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        h = mix(h ^ parts[:, :, j])
    return h.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, content, bands, n_shingles of every row; nulls where it is not comparable."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            doc, s, weight, content = shingles(texts)
            content[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = None
            keys = bands(signatures(doc, s, weight, len(texts)))
            some = [c is not None for c in content]
            ends = np.concatenate(([0], np.cumsum(some))).astype(np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(content.tolist(), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[some].ravel())),
                    pa.array(np.bincount(doc, weights=weight, minlength=len(texts)).astype(np.int64)),
                ],
                names=["doc_id", "content", "bands", "n_shingles"],
            )

    return frozen(docs.mapInArrow(sign, "doc_id long, content binary, bands array<long>, n_shingles long"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, elements) of the documents with the given ids: the sorted hashes of their shingle occurrences.

    The j-th occurrence of a shingle is an element of its own, so common elements add up to the
    smaller weights.
    """
    chosen = ids.select(F.col("node").alias("__node"))
    if ids.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    wanted = docs.join(chosen, F.col("doc_id") == F.col("__node"), "left_semi")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            doc, s, weight, _ = shingles(texts)
            times = weight.astype(np.int64)
            nth = spread(np.zeros(len(s), np.int64), times).astype(np.uint64)
            owner, element = np.repeat(doc, times), mix(np.repeat(s, times) + nth * np.uint64(0x9E3779B97F4A7C15))
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            packed = [np.sort(element[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "elements"])

    # Rows with one id are one document; the greatest set speaks for it.
    return frozen(
        wanted.mapInArrow(collect, "node long, elements binary").groupBy("node").agg(F.max("elements").alias("elements"))
    )


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common elements of every set named in `left` with every one in `right` (places in `sets`)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, held_by = owner[order], held
    begin = np.cumsum(held_by) - held_by
    counts = np.zeros((n, n), np.float32)
    for d in range(2, DENSE + 1):
        columns = begin[held_by == d]
        step = max(1, 2_000_000 // (d * d))
        for at in range(0, len(columns), step):
            who = owner[columns[at : at + step, None] + np.arange(d)]
            pair = who[:, :, None] * n + who[:, None, :]
            counts += np.bincount(pair.ravel(), minlength=n * n).reshape(n, n).astype(np.float32)
    common = np.flatnonzero(held_by > DENSE)
    for at in range(0, len(common), 1024):
        block = common[at : at + 1024]
        table = np.zeros((n, len(block)), np.float32)
        for k, c in enumerate(block):
            table[owner[begin[c] : begin[c] + held_by[c]], k] = 1
        counts += table @ table.T
    return counts[np.ix_(left, right)]


def _linked(table: pa.Table, threshold: float) -> pa.Table:
    """Spanning forest of the links among (node, root, tile, first, second, elements) of one unit."""
    node, root, tile = (table[c].to_numpy() for c in ("node", "root", "tile"))
    sets = [np.frombuffer(e, np.uint64) for e in table["elements"].to_pylist()]
    size = np.array([len(s) for s in sets], np.float64)
    left = np.flatnonzero(tile == table["first"][0].as_py())
    right = np.flatnonzero(tile == table["second"][0].as_py())
    both = shared_counts(sets, left, right)
    near = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-6
    near &= (root[left][:, None] == root[right][None, :]) & (node[left][:, None] != node[right][None, :])
    i, j = np.nonzero(near)
    a, b = forest(node[left[i]], node[right[j]])
    return pa.table({"a": a, "b": b})


def _links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Spanning links (a, b) of all classes among the nodes (node, bands, n_shingles)."""
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    least = exploded.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    members = frozen(exploded.join(least.filter("least < most").drop("most"), "bucket"))
    clusters = frozen(components(members.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    weights = nodes.groupBy("node").agg(F.greatest(F.max("n_shingles"), F.lit(SMALLEST)).alias("weight"))
    weighed = frozen(clusters.join(weights, "node"))
    totals = weighed.groupBy("root").agg(F.sum("weight").alias("total"))
    small = totals.filter(F.col("total") <= TILE).agg(F.sum("total")).first()[0] or 0
    bins = max(1, -(-small // TILE))
    # Small clusters share a unit with others; a large one is dealt into tiles.
    tiles = F.ceil(F.col("total") / TILE)
    large = F.col("total") > TILE
    placed = frozen(
        weighed.join(totals, "root").select(
            "node",
            "root",
            large.alias("large"),
            F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("unit"),
            F.when(large, F.pmod(F.xxhash64("node"), tiles)).otherwise(F.lit(0)).alias("tile"),
        )
    )
    # Two tiles of a large cluster meet if a band has members in both.
    by_bucket = members.join(placed.filter("large"), "node").select("bucket", "unit", "tile").distinct()
    meeting = (
        by_bucket.join(by_bucket.select("bucket", F.col("tile").alias("other")), "bucket")
        .filter("tile < other")
        .select(F.lit(True).alias("large"), "unit", F.col("tile").alias("first"), F.col("other").alias("second"))
        .distinct()
    )
    alone = placed.select("large", "unit", F.col("tile").alias("first"), F.col("tile").alias("second")).distinct()
    units = alone.unionByName(meeting).withColumn(
        "tile", F.explode(F.array_distinct(F.array("first", "second")))
    )
    sets = _sets(docs, placed)
    dealt = (
        placed.join(units, ["large", "unit", "tile"])
        .join(sets, "node")
        .select("large", "unit", "first", "second", "node", "root", "tile", "elements")
    )
    return frozen(
        dealt.groupBy("large", "unit", "first", "second").applyInArrow(
            lambda table: _linked(table, threshold), "a long, b long"
        )
    )


def duplicate_classes(
    docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the class), kept (the row is its class's smallest)."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    signed = _signed(rows)
    comparable = signed.filter("content IS NOT NULL")
    nodes = frozen(
        comparable.groupBy("content").agg(
            F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")
        )
    )
    roots = components(_links(rows, nodes, threshold))
    classes = nodes.select("content", "node").join(roots, "node", "left").select(
        "content", F.coalesce("root", "node").alias("class_id")
    )
    classed = comparable.join(classes, "content").select("doc_id", "class_id")
    alone = signed.filter("content IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return classed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def without_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`docs` with one document of each class, that of the smallest id; rows with a null id stay."""
    classes = duplicate_classes(docs, threshold, id_column, text_column)
    dropped = frozen(classes.filter("NOT kept").select(F.col("doc_id").alias("__dropped")).distinct())
    small = dropped.count() <= BROADCAST_IDS
    left = docs.join(
        F.broadcast(dropped) if small else dropped, F.col(id_column).cast("long") == F.col("__dropped"), "left_anti"
    )
    ids = left.filter(F.col(id_column).isNotNull()).groupBy(id_column).count()
    if ids.filter("count > 1").limit(1).count():
        named = left.filter(F.col(id_column).isNotNull()).dropDuplicates([id_column])
        left = named.unionByName(left.filter(F.col(id_column).isNull()))
    return left
