"""Near duplicates among embeddings by NN-descent.

Every vector keeps a list of its LIST most similar vectors of the same label and length.  The lists
start from neighbours in sorted orders of random sign bits; each round then compares, around every
vector, all members of its list and of a bounded sample of the lists that it is in, and updates the
lists (neighbours of neighbours).  Pairs with a cosine of `threshold` or more are links.

Links that a list has no room for are kept as a spanning forest, so that they join components.

A list that holds links alone is saturated: it may miss some.  Components with such a list are covered
by balls; balls of different components that are near enough to hold a link are compared member by
member, so that no link between two of these components is lost.  The list is then enlarged to its
whole component, whose members are compared with each other in tiles; only numbers of links leave a tile.
Two audits say how much the search found.  About PLANTED vectors, drawn by a hash of their node, get a
partner just above the threshold, in a random direction, that takes part in the search alone: the share of
partners that it finds is the recall of the hardest pairs, without a comparison with all rows, also where
hardly any vector has a link.  SURE / PLANTED is the share that may be missing, with 95 % confidence,
where every partner is found.  Samples of at most AUDIT vectors with few, with many and with no known
links are compared with all rows, in blocks, and the vectors whose links are all known counted, each
vector once.  While fewer than RECALL of either are found, further rounds from other sorted orders
follow.  Only if MOST_REPEATS of them do not reach it, every vector is compared with all of its
label.  Links that an audit finds are kept; the recall before that is returned in each row.

Vectors that are null, empty, zero or hold null or non-finite components, rows without a label and
rows without an id link with nothing.  Equal vectors of a label are compared once and count as often
as they occur.  Very long vectors only make the rows of a block larger.  Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import filesystem, frozen, shared_folder, spread
from .graph import components, forest

THRESHOLD = 0.98
LIST = 10
ORDERS = 5
REACH = 3
ROUNDS = 2
MOST_REPEATS = 4
AUDIT = 512
RECALL = 0.99
TILE = 256
#: A sample that would hold this many of a kind on average holds none of it in 5 % of all cases.
SURE = 3
#: Vectors that get a planted partner, and how far above the threshold it is, as a share of what is left to 1.
PLANTED, ABOVE = 600, 0.02
#: Members of a component that one task covers with balls; rows of a block of an exact comparison.
CHUNK = 256
BLOCK = 2048
#: Rows of a part that one task of a grouped comparison holds.
PART_ROWS = 50_000
SALTS = 32
BITS = 62


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(
        vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _order_keys(nodes: DataFrame, first: int) -> DataFrame:
    """Append keys: for each order the sign bits of BITS random projections."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column(3), batch.column(2).to_numpy()
            keys = np.zeros((batch.num_rows, ORDERS), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = unit(vectors.take(pa.array(rows)))
                for order in range(ORDERS):
                    directions = np.random.default_rng([first + order, dim]).standard_normal((dim, BITS))
                    keys[rows, order] = (x @ directions > 0) @ (1 << np.arange(BITS, dtype=np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * ORDERS, pa.int32()), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["node", "label", "dim", "vector", "keys"])

    kind = nodes.schema["vector"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "dim", "vector").mapInArrow(
        project, f"node long, label {label}, dim int, vector {kind}, keys array<long>"
    )


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted rows (node, label, dim, vector) at most REACH apart, of one label and length."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        batch = table.to_batches()[0]
        new_from = held.num_rows if held is not None else 0
        node, dim = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        label = batch.column(1)
        label = np.asarray(label.to_pylist(), object)
        lists = batch.column(3)
        left, right, sims = [], [], []
        for d in np.unique(dim).tolist():
            rows = np.flatnonzero(dim == d)
            x = unit(lists.take(pa.array(rows)))
            for step in range(1, REACH + 1):
                a, b = np.arange(len(rows) - step), np.arange(step, len(rows))
                ok = (label[rows[a]] == label[rows[b]]) & (rows[b] >= new_from) & (rows[b] - rows[a] == step)
                a, b = a[ok], b[ok]
                left.append(node[rows[a]])
                right.append(node[rows[b]])
                sims.append((x[a] * x[b]).sum(1))
        a, b, s = np.concatenate(left), np.concatenate(right), np.concatenate(sims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((a, b))), pa.array(np.concatenate((b, a))), pa.array(np.concatenate((s, s)))],
            names=["u", "v", "sim"],
        )
        held = batch.slice(max(0, batch.num_rows - REACH))


def _best(pairs: DataFrame, size: int = LIST) -> DataFrame:
    """The `size` most similar v of each u, with the least similarity that a new one must pass."""
    # A first cut inside salted parts keeps a much named u from meeting in one task whole.
    distinct = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    by_salt = Window.partitionBy("u", "salt").orderBy(F.desc("sim"), "v")
    by_u = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    first = salted.withColumn("r", F.row_number().over(by_salt)).filter(F.col("r") <= size)
    ranked = first.withColumn("r", F.row_number().over(by_u)).filter(F.col("r") <= size)
    whole = Window.partitionBy("u")
    passed = F.when(F.count(F.lit(1)).over(whole) >= size, F.min("sim").over(whole)).otherwise(F.lit(-2.0))
    return ranked.withColumn("least", passed).select("u", "v", "sim", "least")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest (a, b) of each task's links (u, v)."""
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _local_join(table: pa.Table, threshold: float) -> pa.Table:
    """Around each centre, candidates (u, v, sim) among its members that improve u's list.

    Rows without `sim` are a spanning forest of all links seen, whether or not a list has room for them.
    """
    table = table.sort_by([("centre", "ascending"), ("member", "ascending")]).combine_chunks()
    centre = table["centre"].to_numpy()
    member = table["member"].to_numpy()
    least = table["least"].to_numpy()
    x = unit(table["vector"].chunk(0)) if table.num_rows else np.zeros((0, 1))
    begin = np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1])))
    size = np.diff(np.append(begin, len(centre)))
    us, vs, sims, linked = [], [], [], []
    for n in np.unique(size).tolist():
        own = begin[size == n]
        for part in np.array_split(own, max(1, len(own) * n // 20_000)):
            at = spread(part, np.full(len(part), n)).reshape(-1, n)
            y = x[at]
            s = y @ y.transpose(0, 2, 1)
            better = (s > least[at][:, :, None]) & (member[at][:, :, None] != member[at][:, None, :])
            g, i, j = np.nonzero(better)
            us.append(member[at[g, i]])
            vs.append(member[at[g, j]])
            sims.append(s[g, i, j])
            g, i, j = np.nonzero((s >= threshold) & (member[at][:, :, None] < member[at][:, None, :]))
            real = (member[at[g, i]] >= 0) & (member[at[g, j]] >= 0)
            linked.append(np.stack(forest(member[at[g, i]][real], member[at[g, j]][real])))
    empty = [np.zeros(0, np.int64)]
    a, b = forest(*np.concatenate(linked or [np.zeros((2, 0), np.int64)], axis=1))
    return pa.table(
        {
            "u": np.concatenate((*us, a, *empty)),
            "v": np.concatenate((*vs, b, *empty)),
            "sim": pa.array(
                np.concatenate((*sims, np.zeros(len(a)))),
                mask=np.arange(sum(map(len, sims)) + len(a)) >= sum(map(len, sims)),
            ),
        }
    )


def _parts(spark: SparkSession, rows: int) -> int:
    """Parts of a grouped comparison: some for every task, and more where the rows of a part would pass PART_ROWS."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(8 * tasks, -(-rows // PART_ROWS))


def _descend(nodes: DataFrame, lists: DataFrame, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """One round of neighbours-of-neighbours: the improved lists, and a forest (a, b) of the links seen."""
    salted = lists.select(F.col("v").alias("centre"), F.col("u").alias("member")).withColumn(
        "salt", F.pmod(F.xxhash64("member"), F.lit(SALTS))
    )
    drawn = F.xxhash64("member", "centre")
    some = Window.partitionBy("centre", "salt").orderBy(drawn)
    few = Window.partitionBy("centre").orderBy(drawn)
    sampled = (
        salted.withColumn("r", F.row_number().over(some))
        .filter(F.col("r") <= LIST)
        .withColumn("r", F.row_number().over(few))
        .filter(F.col("r") <= LIST)
        .select("centre", "member")
    )
    around = (
        lists.select(F.col("u").alias("centre"), F.col("v").alias("member"))
        .unionByName(sampled)
        .unionByName(nodes.select(F.col("node").alias("centre"), F.col("node").alias("member")))
        .distinct()
    )
    least = lists.groupBy("u").agg(F.first("least").alias("least"))
    members = (
        around.join(nodes.select(F.col("node").alias("member"), "dim", "vector"), "member")
        .join(least.withColumnRenamed("u", "member"), "member", "left")
        .withColumn("least", F.coalesce("least", F.lit(-2.0)))
    )
    parts = _parts(nodes.sparkSession, size * (2 * LIST + 1))
    grouped = members.withColumn("part", F.pmod(F.xxhash64("centre"), F.lit(parts)))
    found = frozen(
        grouped.select("part", "dim", "centre", "member", "least", "vector")
        .groupBy("part", "dim")
        .applyInArrow(lambda table: _local_join(table, threshold), "u long, v long, sim double")
    )
    improved = _best(lists.select("u", "v", "sim").unionByName(found.filter("sim IS NOT NULL")))
    return improved, found.filter("sim IS NULL").select(F.col("u").alias("a"), F.col("v").alias("b"))


def _kinds(batch: pa.RecordBatch) -> dict[tuple, list[int]]:
    """The rows of each label and length."""
    rows = defaultdict(list)
    for i, kind in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
        rows[kind].append(i)
    return rows


def _compared(
    left: DataFrame, right: DataFrame, look: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """What `look` makes of every block of `left` with every block of `right` of one label and length.

    `right` lies in the shared folder and is streamed by each task, so that no row is moved once per block.
    """
    path = shared_folder(left.sparkSession)
    right.write.option("compression", "zstd").parquet(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        for batch in batches:
            own = _kinds(batch)
            others = dataset.dataset(folder, filesystem=store, format="parquet")
            for other in others.to_batches(batch_size=BLOCK, use_threads=False):
                for kind, rows in _kinds(other).items():
                    for at in range(0, len(own.get(kind, ())), BLOCK):
                        yield look(batch.take(pa.array(own[kind][at : at + BLOCK])), other.take(pa.array(rows)))

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, "node").mapInArrow(work, schema)


def _cover(table: pa.Table, threshold: float) -> pa.Table:
    """(node, ball, angle): the members of a component's chunks covered by balls around some of them."""
    table = table.sort_by([("root", "ascending"), ("chunk", "ascending"), ("node", "ascending")]).combine_chunks()
    root, chunk, node = (table[c].to_numpy() for c in ("root", "chunk", "node"))
    x = unit(table["vector"].chunk(0)) if table.num_rows else np.zeros((0, 1))
    first = np.flatnonzero(np.concatenate(([True], (root[1:] != root[:-1]) | (chunk[1:] != chunk[:-1]))))
    ball, angle = np.empty(len(node), np.int64), np.zeros(len(node))
    for begin, end in zip(first, np.append(first[1:], len(node))):
        left = np.arange(begin, end)
        while len(left):
            near = x[left] @ x[left[0]]
            inside = near >= threshold
            inside[0] = True
            ball[left[inside]] = node[left[0]]
            angle[left[inside]] = np.arccos(np.clip(near[inside], -1, 1))
            left = left[~inside]
    return pa.table({"node": node, "ball": ball, "angle": angle})


def _with_sizes(members: DataFrame) -> DataFrame:
    """Members (node, root) with the number `m` of their component.

    A component with a third of all members is spread: every size is known in SALTS places.
    """
    places = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m")).select("root", "m", places)
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(frozen(sizes), ["root", "salt"]).drop("salt")


def _across(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """A forest (a, b) of all links between members (node, root) of different components."""
    parts = _parts(nodes.sparkSession, members.count())
    chunked = (
        _with_sizes(members)
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / CHUNK).cast("long")))
        .withColumn("part", F.pmod(F.xxhash64("root", "chunk"), F.lit(parts)))
        .join(nodes.select("node", "dim", "vector"), "node")
    )
    held = frozen(
        chunked.select("part", "dim", "root", "chunk", "node", "vector")
        .groupBy("part", "dim")
        .applyInArrow(lambda table: _cover(table, threshold), "node long, ball long, angle double")
    )
    balls = frozen(
        held.groupBy(F.col("ball").alias("node"))
        .agg(F.max("angle").alias("radius"))
        .join(members, "node")
        .join(nodes.select("node", "label", "dim", "vector"), "node")
    )
    reach = float(np.arccos(threshold)) + 1e-6

    def near(x: pa.RecordBatch, y: pa.RecordBatch) -> pa.RecordBatch:
        a, b = x.column("node").to_numpy(), y.column("node").to_numpy()
        s = unit(x.column("vector")) @ unit(y.column("vector")).T
        apart = (x.column("root").to_numpy()[:, None] != y.column("root").to_numpy()) & (a[:, None] < b)
        radii = x.column("radius").to_numpy()[:, None] + y.column("radius").to_numpy()
        i, j = np.nonzero(apart & (np.arccos(np.clip(s, -1, 1)) <= radii + reach))
        return pa.RecordBatch.from_arrays(
            [pa.array(a[i]), pa.array(b[j]), pa.array(s[i, j] >= threshold)], names=["a", "b", "linked"]
        )

    close = frozen(_compared(balls, balls, near, "a long, b long, linked boolean"))
    direct = close.filter("linked").select("a", "b")
    # Balls whose centres' links join their components already are not compared again.
    owner = balls.select("node", "root")
    ends = lambda pairs: (
        pairs.join(owner.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a")
        .join(owner.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
    )
    merged = frozen(components(ends(direct).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
    final = lambda side: merged.select(F.col("node").alias(f"root_{side}"), F.col("root").alias(f"new_{side}"))
    undecided = (
        ends(close.filter("NOT linked"))
        .join(final("a"), "root_a", "left")
        .join(final("b"), "root_b", "left")
        .filter(F.coalesce("new_a", "root_a") != F.coalesce("new_b", "root_b"))
        .select("a", "b")
    )
    sides = undecided.withColumn("ball", F.explode(F.array("a", "b"))).withColumn("second", F.col("ball") == F.col("b"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, node, second = unit(table["vector"].chunk(0)), table["node"].to_numpy(), table["second"].to_numpy()
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        i, j = np.nonzero(x[a] @ x[b].T >= threshold)
        left, right = forest(node[a[i]], node[b[j]])
        return pa.table({"a": left, "b": right})

    found = (
        sides.join(held.select("node", "ball"), "ball")
        .join(nodes.select("node", "vector"), "node")
        .groupBy("a", "b")
        .applyInArrow(compare, "a long, b long")
    )
    return direct.unionByName(found)


def _tile_counts(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): linked rows of other nodes, for members (node, root) of enlarged components."""
    tiles = F.ceil(F.col("m") / TILE).cast("long")
    dealt = (
        _with_sizes(members)
        .withColumn("tile", F.pmod(F.xxhash64("node"), tiles))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        .select(
            "node",
            "root",
            "tile",
            F.least("tile", "other").alias("first"),
            F.greatest("tile", "other").alias("second"),
        )
        .join(nodes.select("node", "copies", "vector"), "node")
    )

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, tile, copies = (table[c].to_numpy() for c in ("node", "tile", "copies"))
        x = unit(table["vector"].chunk(0))
        a, b = np.flatnonzero(tile == table["first"][0].as_py()), np.flatnonzero(tile == table["second"][0].as_py())
        near = x[a] @ x[b].T >= threshold
        if len(a) == len(b) and (a == b).all():
            np.fill_diagonal(near, False)
            return pa.table({"node": node[a], "links": near @ copies[b]})
        return pa.table(
            {
                "node": np.concatenate((node[a], node[b])),
                "links": np.concatenate((near @ copies[b], near.T @ copies[a])),
            }
        )

    return (
        dealt.groupBy("root", "first", "second")
        .applyInArrow(count, "node long, links long")
        .groupBy("node")
        .agg(F.sum("links").alias("links"))
    )


def _links(nodes: DataFrame, lists: DataFrame, spare: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Components (node, root) and numbers of linked rows of other nodes (node, links).

    `spare` holds links (a, b) beside those of the lists.
    """
    listed = frozen(lists.filter(F.col("sim") >= threshold).select("u", "v"))
    near = listed.filter((F.col("u") >= 0) & (F.col("v") >= 0))
    both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    listed_links = near.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(spare)
    roots = frozen(components(listed_links))
    saturated = frozen(
        # A planted partner may take a place in a list.
        listed.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LIST).select("node")
    )
    enlarged = frozen(roots.join(saturated, "node").select("root").distinct())
    if enlarged.count() > 1:
        across = frozen(_across(nodes, frozen(roots.join(enlarged, "root").select("node", "root")), threshold))
        roots = frozen(components(listed_links.unionByName(across)))
        enlarged = frozen(roots.join(saturated, "node").select("root").distinct())
    tiled = frozen(_tile_counts(nodes, roots.join(enlarged, "root"), threshold))
    known = (
        both.join(nodes.select(F.col("node").alias("v"), "copies"), "v")
        .groupBy(F.col("u").alias("node"))
        .agg(F.sum("copies").alias("links"))
    )
    counts = tiled.unionByName(known.join(tiled.select("node"), "node", "left_anti"))
    return roots, frozen(counts)


def _all_links(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """Of the links of the asked nodes, found by comparison with all nodes, three kinds of rows (u, v, sim, links).

    Rows without `v`: numbers of linked rows per block.  With `sim`: each asked node's best LIST links of each
    block, both ways.  With `v` alone: a spanning forest of each block's links.
    """

    def look(x: pa.RecordBatch, y: pa.RecordBatch) -> pa.RecordBatch:
        a, b = x.column("node").to_numpy(), y.column("node").to_numpy()
        s = unit(y.column("vector")) @ unit(x.column("vector")).T
        near = (s >= threshold) & (b[:, None] != a)
        links = near @ x.column("copies").to_numpy()
        j, i = np.nonzero(near)
        u, v = forest(b[j], a[i])
        order = np.lexsort((a[i], -s[j, i], j))
        j, i = j[order], i[order]
        best = np.arange(len(j)) - np.searchsorted(j, j) < LIST
        j, i = j[best], i[best]
        some = np.flatnonzero(links)
        n, m = len(some), 2 * len(j)
        at = np.arange(n + m + len(u))
        none = np.zeros(n, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((b[some], b[j], a[i], u))),
                pa.array(np.concatenate((none, a[i], b[j], v)), mask=at < n),
                pa.array(np.concatenate((none, s[j, i], s[j, i], np.zeros(len(u)))), mask=(at < n) | (at >= n + m)),
                pa.array(np.concatenate((links[some], np.zeros(m + len(u), np.int64))), mask=at >= n),
            ],
            names=["u", "v", "sim", "links"],
        )

    asked = asked.select("node", "label", "dim", "vector")
    rows = nodes.select("node", "label", "dim", "vector", "copies")
    return frozen(_compared(rows, asked, look, "u long, v long, sim double, links long"))


def _audited(nodes: DataFrame, counts: DataFrame, threshold: float, most: int) -> tuple[float, DataFrame]:
    """Least share of whole vectors of any stratum, and what `_all_links` found for the samples.

    Strata are the vectors with no known link, with fewer than LIST linked rows, and with more.
    """
    strata = frozen(
        nodes.join(counts.select("node", "links"), "node", "left").select(
            "node",
            F.coalesce("links", F.lit(0)).alias("known"),
            F.when(F.coalesce("links", F.lit(0)) == 0, 0).when(F.col("links") < LIST, 1).otherwise(2).alias("stratum"),
        )
    )
    sizes = {r.stratum: r["count"] for r in strata.groupBy("stratum").count().collect()}
    wanted = dict.fromkeys((0, 1, 2), most)
    steps = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(steps))
    share = {k: steps * min(1.0, wanted[k] / n) for k, n in sizes.items()}
    sample = strata.filter(
        F.coalesce(*(F.when(F.col("stratum") == k, drawn < int(x)) for k, x in share.items()), F.lit(False))
    )
    sample = frozen(sample)
    found = _all_links(nodes, nodes.join(sample.select("node"), "node"), threshold)
    exact = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("exact"))
    seen = {
        r.stratum: r
        for r in sample.join(exact, "node", "left")
        .groupBy("stratum")
        .agg(
            F.count(F.lit(1)).alias("asked"),
            F.count("exact").alias("linked"),
            F.count(F.when(F.col("known") >= F.col("exact"), 1)).alias("whole"),
        )
        .collect()
    }
    shares = [seen[k].whole / seen[k].linked for k in (1, 2) if k in seen and seen[k].linked]
    if 0 in seen and seen[0].linked:
        # A lone vector that has a link weighs against the vectors of small groups.
        missed = sizes[0] * seen[0].linked / seen[0].asked
        shares.append(sizes.get(1, 0) / (sizes.get(1, 0) + missed))
    return min(shares, default=1.0), found


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, most: int = AUDIT) -> float:
    """Share of the linked vectors whose links are all known, in the worst stratum of `_audited`."""
    return _audited(nodes, counts, threshold, most)[0]


def planted(nodes: DataFrame, threshold: float, most: int = PLANTED) -> DataFrame:
    """Partners (node below 0) of about `most` nodes of two or more dimensions, a little above the threshold."""
    steps, size = 1 << 30, nodes.count()
    drawn = F.pmod(F.xxhash64(F.lit("planted"), "node"), F.lit(steps)) < int(steps * min(1.0, most / max(size, 1)))
    near = threshold + ABOVE * (1 - threshold)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for node, vector in zip(batch.column(0).to_pylist(), batch.column(3)):
                x = unit(pa.array([vector.as_py()], batch.schema.field(3).type))[0]
                side = np.random.default_rng(node).standard_normal(len(x))
                side -= x * (side @ x)
                vectors.append(near * x + np.sqrt(1 - near * near) * side / np.sqrt(side @ side))
            node = pa.array(-batch.column(0).to_numpy() - 1)
            yield pa.RecordBatch.from_arrays([node, batch.column(1), batch.column(2), pa.array(vectors, batch.schema.field(3).type)], names=batch.schema.names)

    rows = nodes.filter(drawn & (F.col("dim") > 1)).select("node", "label", "dim", "vector")
    return rows.mapInArrow(turn, rows.schema)


def planted_recall(partners: DataFrame, lists: DataFrame, threshold: float) -> float:
    """Share of the planted partners whose list holds the vector they belong to, or is full of links."""
    near = lists.filter((F.col("u") < 0) & (F.col("sim") >= threshold))
    by_partner = near.groupBy(F.col("u").alias("node")).agg(
        F.max((F.col("v") == -F.col("u") - 1).cast("int")).alias("own"), F.count(F.lit(1)).alias("n")
    )
    met = (F.col("own") == 1) | (F.col("n") >= LIST)
    asked, found = partners.join(by_partner, "node", "left").agg(F.count(F.lit(1)), F.count(F.when(met, 1))).first()
    return found / asked if asked else 1.0


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest id of the component), kept, and the audited recall of the search."""
    rows = frozen(
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"),
            F.col(label_column).alias("label"),
            F.col(vector_column).alias("vector"),
        )
    )
    fit = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    named = rows.filter(fit)
    nodes = frozen(
        named.groupBy("label", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
        .withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")})
    )
    partners = frozen(planted(nodes, threshold))
    searched = frozen(nodes.select("node", "label", "dim", "vector").unionByName(partners))
    size = searched.count()
    lists, counts, roots, spare = None, None, None, []
    for repeat in range(MOST_REPEATS):
        keyed = frozen(_order_keys(searched, repeat * ORDERS))
        pairs = None if lists is None else lists.select("u", "v", "sim")
        for order in range(ORDERS):
            by = ["label", "dim", "key", "node"]
            in_order = (
                keyed.withColumn("key", F.col("keys")[order])
                .select("node", "label", "dim", "vector", "key")
                .repartitionByRange(*by)
                .sortWithinPartitions(*by)
                .drop("key")
            )
            found = in_order.mapInArrow(_adjacent, "u long, v long, sim double")
            pairs = found if pairs is None else pairs.unionByName(found)
        pairs = frozen(pairs)
        linked = pairs.filter((F.col("sim") >= threshold) & (F.col("u") >= 0) & (F.col("u") < F.col("v"))).select("u", "v")
        spare.append(linked.mapInArrow(_forest, "a long, b long"))
        lists = frozen(_best(pairs))
        for _ in range(ROUNDS):
            improved, links = _descend(searched, lists, threshold, size)
            lists = frozen(improved)
            spare.append(links)
        spare = [frozen(reduce(DataFrame.unionByName, spare).distinct())]
        roots, counts = _links(nodes, lists, spare[0], threshold)
        recall, found = _audited(nodes, counts, threshold, AUDIT)
        reached = min(recall, planted_recall(partners, lists, threshold))
        if reached < RECALL and repeat == MOST_REPEATS - 1:
            found = _all_links(nodes, nodes, threshold)
        if recall < 1 or (reached < RECALL and repeat == MOST_REPEATS - 1):
            pairs = lists.select("u", "v", "sim").unionByName(found.filter("sim IS NOT NULL").select("u", "v", "sim"))
            lists = frozen(_best(pairs))
            more = found.filter("v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b"))
            spare = [frozen(spare[0].unionByName(more).distinct())]
        if reached >= RECALL or repeat == MOST_REPEATS - 1:
            break
    if recall < 1 or reached < RECALL:
        roots, counts = _links(nodes, lists, spare[0], threshold)
    smallest = (
        nodes.join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .select("node", "root", "label", "vector", "copies", "least_id")
    )
    by_root = smallest.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = (
        smallest.join(by_root, "root")
        .join(counts, "node", "left")
        .select(
            F.col("label").alias("__label"),
            F.col("vector").alias("__vector"),
            "component_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    linked = named.join(
        known, (F.col("label") == F.col("__label")) & (F.col("vector") == F.col("__vector"))
    ).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fit).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).withColumns({"kept": kept, "recall": F.lit(float(reached))})
