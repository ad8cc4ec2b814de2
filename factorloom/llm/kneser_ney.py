"""Interpolated modified Kneser-Ney model: counted in Spark, stored as sorted arrays, memory-mapped.

Level 1 lists the 64-bit hashes of the training words in order; a word's place is its id.  Level k
lists the k-grams as numbers `(place of the first k - 1 words in level k - 1) << 32 | id of the last
word`, again in order.  A level is cut by key range into shards, each an array file in the shared
folder next to the k-grams' counts and their contexts' totals and back-off weights; workers map the
files into memory and look up the sorted queries of a batch by binary search.  Counts take a byte each, and
those of 255 and more are listed whole beside them.

Counting merges sorted runs: a task sends each shard one compressed run per few million tokens.
Counts of level k < order are the numbers of different words seen before the k-gram (the plain
count where it starts a text).  With c the adjusted count, D its discount and g the weight that the
discounts of a context free,

    P(w | context) = max(c - D(c), 0) / total + g * P(w | shorter context),

down to the uniform 1 / (V + 1) over the training words and one unknown word.

Tokens are the words with A-Z lowered and one end per text.  A null or empty text is its end alone.
Repeated rows count as often as they occur; a null id is in the training part; other columns are not
read.  A very long text is taken alone and scored whole.  Without training rows every token has
probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import Texts, filesystem, frozen, lowered, shared_folder, span_hashes, spread, text_batches

ORDER = 3
#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(0), np.uint64(1)
RUN_TOKENS = 4_000_000
LOW = np.uint64(0xFFFFFFFF)
ESCAPE = 255
#: Stands for the type of a file of `save_counts`.
COUNTS = "counts"
SHIFT = np.uint64(32)


# --- array files ------------------------------------------------------------------------------


def save(uri: str, array: np.ndarray) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as sink:
        sink.write(np.ascontiguousarray(array).tobytes())


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The array file mapped into memory; from a remote store by way of an unlinked local copy."""
    fs, path = filesystem(uri)
    if not fs.get_file_info(path).size:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r")
    with tempfile.NamedTemporaryFile() as local:
        with fs.open_input_stream(path) as source:
            while block := source.read(8 << 20):
                local.write(block)
        local.flush()
        return np.memmap(local.name, dtype, "r")


def save_counts(uri: str, counts: np.ndarray) -> None:
    """One byte a count; those of ESCAPE and more lie whole in a second file, with their places."""
    save(uri, np.minimum(counts, ESCAPE).astype(np.uint8))
    large = np.flatnonzero(counts >= ESCAPE)
    save(uri + ".large", np.stack((large.astype("<u8"), counts[large].astype("<u8"))))


def counts_of(uri: str, places: np.ndarray | slice) -> np.ndarray:
    """The counts at some places of a file of `save_counts`, as 64-bit numbers."""
    out = np.asarray(_array(uri, "u1")[places]).astype(np.uint64)
    large = np.flatnonzero(out == ESCAPE)
    if len(large):
        at, values = _array(uri + ".large", "<u8").reshape(2, -1)
        own = large + (places.start or 0) if isinstance(places, slice) else places[large]
        out[large] = values[np.searchsorted(at, own.astype(np.uint64))]
    return out


_mapped: dict[tuple[str, str], np.ndarray] = {}


def _array(uri: str, dtype: str) -> np.ndarray:
    if (uri, dtype) not in _mapped:
        if len(_mapped) > 4096:
            _mapped.clear()
        _mapped[uri, dtype] = mapped(uri, dtype)
    return _mapped[uri, dtype]


@dataclass
class Level:
    """One level's shards: file stems, and the key and place at which each shard begins."""

    stems: list[str]
    first_keys: np.ndarray
    first_places: np.ndarray
    size: int
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    adjusted: list[str] = field(default_factory=list)
    contexts: list[str] = field(default_factory=list)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the level, -1 where it isn't."""
        found = np.full(len(keys), -1, np.int64)
        if not self.size or not len(keys):
            return found
        shard = np.searchsorted(self.first_keys, keys, "right") - 1
        cuts = np.searchsorted(shard, np.arange(len(self.stems) + 1))
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                own = _array(self.stems[s] + ".keys", "<u8")
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                found[a:b] = np.where(own[at] == keys[a:b], self.first_places[s] + at, -1)
        return found

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(keys, return_inverse=True)
        return self.places(distinct)[which]

    def values(self, files: list[str], dtype: str, places: np.ndarray) -> np.ndarray:
        """Entries of an array that runs along the level, 0 for place -1."""
        distinct, which = np.unique(places, return_inverse=True)
        got = np.zeros(len(distinct), np.uint64 if dtype == COUNTS else dtype)
        shard = np.searchsorted(self.first_places, distinct, "right") - 1
        for s in np.unique(shard[distinct >= 0]).tolist():
            own = (shard == s) & (distinct >= 0)
            at = distinct[own] - self.first_places[s]
            got[own] = counts_of(files[s], at) if dtype == COUNTS else _array(files[s], dtype)[at]
        return got[which]


# --- sorted runs ------------------------------------------------------------------------------


def _columns(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts, as differences byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return zstandard.ZstdCompressor(level=1).compress(_columns(steps) + _columns(counts))


def unpack_run(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(run), np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(p.T).view("<u8").ravel() for p in plain)
    return np.cumsum(steps, dtype=np.uint64), counts


def merge_runs(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack_run(r) for r in runs]
    keys, counts = (np.concatenate(p) for p in zip(*parts))
    return added(keys, counts)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _cut(keys: np.ndarray, counts: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Runs of a sorted list per shard; shard s holds the keys from borders[s] on."""
    cuts = np.append(np.searchsorted(keys, borders), len(keys))
    for shard, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a < b:
            yield shard, pack_run(keys[a:b], counts[a:b])


RUNS = pa.schema([("shard", pa.int32()), ("run", pa.binary())])


def _run_batches(pairs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for shard, run in pairs:
        yield pa.RecordBatch.from_pylist([{"shard": shard, "run": run}], RUNS)


# --- tokens -----------------------------------------------------------------------------------


def token_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of START, the words and END of each text, and the n + 1 borders between texts."""
    buf = lowered(texts.buf)
    starts, ends, owner = texts.words()
    count = np.bincount(owner, minlength=len(texts)) + 2
    borders = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(int(borders[-1]), np.uint64)
    out[borders[:-1]] = START
    out[borders[1:] - 1] = END
    # Words keep clear of the two marks.
    out[spread(borders[:-1] + 1, count - 2)] = np.maximum(span_hashes(buf, starts, ends), np.uint64(2))
    return out, borders


def chain(levels: list[Level], hashes: np.ndarray, borders: np.ndarray, upto: int) -> list[np.ndarray]:
    """For k = 1 .. upto the place of the k-gram that ends at each token, -1 where there is none."""
    places = [levels[0].lookup(hashes)]
    begins = np.zeros(len(hashes), bool)
    begins[borders[:-1]] = True
    for level in levels[1:upto]:
        places.append(_step(level, places, begins))
    return places


def _keys(places: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a next longer gram may end, and its key there."""
    context = np.concatenate(([-1], places[-1][:-1]))
    ok = (context >= 0) & (places[0] >= 0) & ~begins
    return ok, (context[ok].astype(np.uint64) << SHIFT) | places[0][ok].astype(np.uint64)


def _step(level: Level, places: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
    ok, keys = _keys(places, begins)
    out = np.full(len(ok), -1, np.int64)
    out[ok] = level.lookup(keys)
    return out


# --- counting ---------------------------------------------------------------------------------


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the id's CRC-32 leaves remainder 2 by 7."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 7 == 2, F.lit(False))


def _count(rows: DataFrame, levels: list[Level], borders: np.ndarray) -> DataFrame:
    """Runs of the grams one longer than `levels` knows, per shard."""
    k = len(levels) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _run_batches(_cut(keys, counts, borders))

        for _, texts in text_batches(batches, "text"):
            hashes, ends = token_hashes(texts)
            if k == 1:
                keys = hashes
            else:
                begins = np.zeros(len(hashes), bool)
                begins[ends[:-1]] = True
                keys = _keys(chain(levels, hashes, ends, k - 1), begins)[1]
            held.append(keys)
            size += len(keys)
            if size >= RUN_TOKENS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return rows.mapInArrow(count, "shard int, run binary")


STATS = "shard int, stem string, n long, first_key long, total long, n1 long, n2 long, n3 long, n4 long, more long"


def _stats(shard: int, stem: str, n: int, first_key: int, counts: np.ndarray) -> pa.Table:
    of = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6).tolist()
    signed = int(np.uint64(first_key).astype(np.int64))
    row = dict(shard=shard, stem=stem, n=n, first_key=signed, total=int(counts.sum()))
    row |= dict(n1=of[1], n2=of[2], n3=of[3], n4=of[4], more=of[5])
    kinds = [("shard", pa.int32()), ("stem", pa.string())]
    kinds += [(c, pa.int64()) for c in ("n", "first_key", "total", "n1", "n2", "n3", "n4", "more")]
    return pa.Table.from_pylist([row], pa.schema(kinds))


def _merged(runs: DataFrame, folder: str, top: bool) -> list:
    """Merge each shard's runs into array files; returns one small row per shard."""

    def merge(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = merge_runs(table["run"].to_pylist())
        stem = f"{folder}/{uuid.uuid4().hex}"
        save(stem + ".keys", keys)
        save_counts(stem + ".counts", counts)
        if top and keys[0] == START:  # the start mark is no token
            keep = keys != START
            return _stats(shard, stem, len(keys), keys[0], counts[keep])
        return _stats(shard, stem, len(keys), keys[0], counts)

    return sorted(frozen(runs.groupBy("shard").applyInArrow(merge, STATS)).collect(), key=lambda r: r.shard)


def _level(rows: list) -> Level:
    sizes = np.array([r.n for r in rows], np.int64)
    keys = np.array([r.first_key for r in rows], np.int64).view(np.uint64)
    return Level([r.stem for r in rows], keys, np.cumsum(sizes) - sizes, int(sizes.sum()))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more; halves of the counts where too few counts are known."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in enumerate(found, 1))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


@dataclass
class Model:
    levels: list[Level]
    #: Sum of the level-1 adjusted counts, and the weight they leave to the uniform distribution.
    total: int
    weight: float
    tokens: int
    types: int

    def probabilities(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, plain count and probabilities (smoothed model) of every token but START."""
        hashes, borders = token_hashes(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(borders))
        begins = np.zeros(len(hashes), bool)
        begins[borders[:-1]] = True
        places = chain(self.levels, hashes, borders, len(self.levels))
        first = self.levels[0]
        plain = first.values([s + ".counts" for s in first.stems], COUNTS, places[0])
        p = np.full(len(hashes), self.weight / (self.types + 1))
        if self.total:
            adjusted = first.values(first.adjusted, COUNTS, places[0]).astype(float)
            p += (adjusted - _discount(adjusted, first.discounts)) / self.total
        for k, level in enumerate(self.levels[1:], 1):
            context = np.concatenate(([-1], places[k - 1][:-1]))
            context[begins] = -1
            known = context >= 0
            below = self.levels[k - 1]
            total = below.values([c + ".total" for c in level.contexts], COUNTS, np.where(known, context, -1)).astype(float)
            known &= total > 0
            weight = below.values([c + ".weight" for c in level.contexts], "<f4", np.where(known, context, -1))
            counts = level.values(level.adjusted, COUNTS, places[k]).astype(float)
            own = (counts - _discount(counts, level.discounts)) / np.where(known, total, 1)
            p = np.where(known, own + weight * p, p)
        token = ~begins
        return owner[token], plain[token], p[token], places[0][token]


def train(
    docs: DataFrame, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None
) -> Model:
    """Count and store the model of the rows that aren't held out.

    `shards` cuts every level; it should grow with the corpus, and follows the number of shuffle
    partitions by default.  The driver keeps one small row per shard.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark)
    rows = docs.filter(~held_out(id_column)).select(F.col(text_column).cast("string").alias("text"))
    borders = (np.arange(shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)
    merged = _merged(_count(rows, [], borders), folder, True)
    if not merged:
        return Model([Level([], np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)], 0, 1.0, 0, 0)
    tokens, types = sum(r.total for r in merged), sum(r.n for r in merged) - 1
    stats, levels = [merged], [_level(merged)]
    for _ in range(2, order + 1):
        below = levels[-1].size
        if below > int(LOW):
            raise ValueError("a level over 2^32 grams can't be a context; use a lower order")
        borders = (np.arange(shards, dtype=np.uint64) * np.uint64(below) // np.uint64(shards)) << SHIFT
        merged = _merged(_count(rows, levels, borders), folder, False)
        stats.append(merged)
        levels.append(_level(merged))
    levels[-1].adjusted = [s + ".counts" for s in levels[-1].stems]
    for k in range(order - 1, 0, -1):
        stats[k - 1] = _continuations(spark, levels, k, folder)
    for level, merged in zip(levels, stats):
        level.discounts = discounts(*(sum(getattr(r, c) for r in merged) for c in ("n1", "n2", "n3", "n4")))
    for k in range(1, order):
        _weights(spark, levels, k, folder)
    total = sum(r.total for r in stats[0])
    free = [sum(r.n1 for r in stats[0]), sum(r.n2 for r in stats[0]), sum(r.n3 + r.n4 + r.more for r in stats[0])]
    weight = sum(d * n for d, n in zip(levels[0].discounts, free)) / total
    return Model(levels, total, weight, tokens, types)


def _each_shard(spark, level: Level, work, schema: str) -> DataFrame:
    """Run `work(shard)` in a task per shard of the level."""
    n = len(level.stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield from work(shard)

    return spark.range(n).repartition(n, "id").mapInArrow(run, schema)


def _continuations(spark, levels: list[Level], k: int, folder: str) -> list:
    """Adjusted counts of level k: words seen before each gram, from the grams of level k + 1."""
    upper, lower = levels[k], levels[k - 1]
    borders = lower.first_places.astype(np.uint64)
    plain = [s + ".counts" for s in lower.stems]
    sizes = np.diff(np.append(lower.first_places, lower.size))

    def suffixes(keys: np.ndarray, n: int) -> np.ndarray:
        """Places in level n - 1 of the grams without their first words, of keys of level n."""
        last = keys & LOW
        if n == 2:
            return last.astype(np.int64)
        context = (keys >> SHIFT).astype(np.int64)
        shorter = levels[n - 2]
        context_keys = shorter.values([s + ".keys" for s in shorter.stems], "<u8", context)
        return levels[n - 2].lookup((suffixes(context_keys, n - 1).astype(np.uint64) << SHIFT) | last)

    def work(shard: int) -> Iterator[pa.RecordBatch]:
        own = np.asarray(_array(upper.stems[shard] + ".keys", "<u8"))
        places, counts = np.unique(suffixes(own, k + 1), return_counts=True)
        yield from _run_batches(_cut(places.astype(np.uint64), counts, borders))

    def adjust(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        places, counts = merge_runs(table["run"].to_pylist())
        dense = np.zeros(int(sizes[shard]), np.uint64)
        dense[places.astype(np.int64) - lower.first_places[shard]] = counts
        # A gram that starts a text has nothing before it: its plain count.
        counted = counts_of(plain[shard], slice(None))
        dense = np.where(dense > 0, dense, counted)
        if k == 1:
            dense[np.asarray(_array(lower.stems[shard] + ".keys", "<u8")) == START] = 0
        stem = f"{folder}/{uuid.uuid4().hex}"
        save_counts(stem + ".adjusted", dense)
        return _stats(shard, stem, len(dense), 0, dense)

    runs = _each_shard(spark, upper, work, "shard int, run binary")
    merged = {r.shard: r for r in frozen(runs.groupBy("shard").applyInArrow(adjust, STATS)).collect()}
    # A shard of starts alone has no run: its plain counts stand.
    lower.adjusted = [merged[s].stem + ".adjusted" if s in merged else plain[s] for s in range(len(lower.stems))]
    return list(merged.values())


def _weights(spark, levels: list[Level], k: int, folder: str) -> None:
    """Totals and back-off weights of the contexts of level k + 1, along level k."""
    upper, lower = levels[k], levels[k - 1]
    borders = np.append(lower.first_places, lower.size)

    def work(shard: int) -> Iterator[pa.RecordBatch]:
        lo, hi = int(borders[shard]), int(borders[shard + 1])
        total, weight = np.zeros(hi - lo), np.zeros(hi - lo)
        first, last = (np.uint64(x) << SHIFT for x in (lo, hi))
        s = max(int(np.searchsorted(upper.first_keys, first, "right")) - 1, 0)
        while s < len(upper.stems) and upper.first_keys[s] < last:
            keys = _array(upper.stems[s] + ".keys", "<u8")
            a, b = np.searchsorted(keys, [first, last])
            counts = counts_of(upper.adjusted[s], slice(int(a), int(b))).astype(float)
            context = (np.asarray(keys[a:b]) >> SHIFT).astype(np.int64) - lo
            total += np.bincount(context, weights=counts, minlength=hi - lo)
            weight += np.bincount(context, weights=_discount(counts, upper.discounts), minlength=hi - lo)
            s += 1
        stem = f"{folder}/{uuid.uuid4().hex}"
        save_counts(stem + ".total", total.astype(np.uint64))
        save(stem + ".weight", np.divide(weight, total, out=np.zeros_like(weight), where=total > 0).astype("<f4"))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "stem": [stem]})

    done = {r.shard: r.stem for r in frozen(_each_shard(spark, lower, work, "shard int, stem string")).collect()}
    upper.contexts = [done[s] for s in range(len(lower.stems))]


# --- scoring ----------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    smoothing = model.tokens + model.types + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            owner, plain, p, _ = model.probabilities(texts)
            n = len(texts)
            tokens = np.bincount(owner, minlength=n)
            logs = np.bincount(owner, weights=np.log10(p), minlength=n)
            base = np.bincount(owner, weights=np.log10((plain + 1.0) / smoothing), minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tokens),
                    pa.array(np.bincount(owner, weights=plain > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, model.tokens)),
                    pa.array(base),
                    pa.array(logs),
                    pa.array(10 ** (-logs / tokens)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double,"
        " perplexity double",
    )
