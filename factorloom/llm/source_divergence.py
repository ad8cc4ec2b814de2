"""Divergence of the sources of each language, from exact term counts by a minimal-perfect-hash recount.

1. A first pass counts in how many documents of a language each term occurs, exactly, and keeps the
   terms of at least `min_docs` documents.
2. The kept (language, term) keys are dealt into shards by hash, and each shard gets a minimal perfect
   hash with its keys stored beside it, as one file in the shared folder.
3. A second pass counts again: a task looks its terms up, checks the stored key and increments a dense
   array of slots per (language, source, shard).  Shards reach the workers through the shared folder: a
   task fetches one when it first meets a term of it and keeps at most CACHE_BYTES of shards and
   DENSE_BYTES of arrays, so its memory does not depend on the vocabulary.
4. Smoothed shares of the terms and their divergences are whole numbers, computed per shard from
   dense count matrices of at most 2 x TILE sources.

A term is a maximal run of ASCII letters and characters beyond ASCII, with A-Z lower-cased.  Null text,
language or source count as ''.  Every row is a document, repeated rows too.  An empty text has no
term, but its group occurs.  Very long texts are counted whole.  Other columns are not read; an empty
table gives no rows.  Ties in a ranking go by the item's UTF-8 bytes.  Counts are exact up to
9 * 10**15 terms a language.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Texts, filesystem, frozen, letters, lowered, mix, shared_folder, span_hashes, text_batches
from .perfect_hash import PerfectHash, strings

MIN_DOCS, TOP, STEPS = 10, 10, 1_000_000_000
#: Expected keys of a shard, sources of a tile, bytes of text that are counted at a time.
SHARD_KEYS, TILE, COUNT_BYTES = 8_192, 32, 4 << 20
CACHE_BYTES, DENSE_BYTES = 48 << 20, 48 << 20
#: Stands for the whole language in place of a source's number.
WHOLE = -1


# --- terms ----------------------------------------------------------------------------------------


def _terms(texts: Texts) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the text that each is from."""
    inside = letters(texts.buf)
    starts, ends, owner = texts.words(inside)
    return strings(lowered(texts.buf)[inside], ends - starts), owner


def _hash(values: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    buf = np.frombuffer(values.buffers()[2], np.uint8) if len(values) and offsets[-1] else np.zeros(0, np.uint8)
    return span_hashes(buf, offsets[:-1], offsets[1:])


def _keys(langs: pa.Array, lang: np.ndarray, terms: pa.Array, term: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Hash and stored form of (language, term) pairs; a term holds no zero byte, so the last one ends the language."""
    names = langs.cast(pa.large_string()).cast(pa.large_binary())
    joined = pc.binary_join_element_wise(names.take(pa.array(lang)), terms.take(pa.array(term)), pa.scalar(b"\0", pa.large_binary()))
    return mix(_hash(terms)[term] ^ mix(_hash(names)[lang])), joined


def _pairs(first: np.ndarray, second: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of numbers, the second ones below `width`, and how often each occurs."""
    key = np.sort(first * width + second)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[new] // width, key[new] % width, np.diff(np.append(new, len(key)))


def _numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value, and the values in the order of their numbers."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, term, documents that hold it), summed over stretches of text."""
    for batch, texts in text_batches(batches, "text", COUNT_BYTES):
        lang, langs = _numbered(batch.column(0))
        terms, owner = _terms(texts)
        code, unique = _numbered(terms)
        width = max(1, len(unique))
        document, code, _ = _pairs(owner, code, width)
        own, code, n = _pairs(lang[document], code, width)
        words = unique.take(pa.array(code)).cast(pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(own)), words, pa.array(n)], names=["lang", "term", "n"])


def plain(docs: DataFrame) -> DataFrame:
    """lang, source and text as strings without nulls."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) in at least `min_docs` documents of the language; exact."""
    counted = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    return frozen(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term"))


# --- perfect hashes -------------------------------------------------------------------------------


def _hashed(langs: pa.Array, terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    lang, names = _numbered(langs)
    return _keys(names, lang, terms.cast(pa.large_string()).cast(pa.large_binary()), np.arange(len(terms)))


def build_shards(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """Write one perfect hash per shard; returns (shard, path, lang, terms) rows and the number of shards."""
    shards = max(1, -(-kept.count() // shard_keys))
    folder = shared_folder(kept.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _ = _hashed(batch.column(0), batch.column(1))
            shard = pa.array((hashes % np.uint64(shards)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([shard, batch.column(0), batch.column(1)], names=["shard", "lang", "term"])

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        langs, terms = table.column("lang").chunk(0), table.column("term").chunk(0)
        hashes, keys = _hashed(langs, terms)
        path = f"{folder}/shard-{table.column('shard')[0].as_py():06d}-{uuid.uuid4().hex}.mph"
        fs, local = filesystem(path)
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(local) as sink:
            sink.write(PerfectHash.build(hashes, keys).tobytes())
        counted = pc.value_counts(langs)
        n = len(counted)
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int32()),
            "path": [path] * n,
            "lang": counted.field("values"),
            "terms": counted.field("counts").cast(pa.int64()),
        })

    dealt = kept.select("lang", "term").mapInArrow(deal, "shard int, lang string, term string")
    built = dealt.groupBy("shard").applyInArrow(build, "shard int, path string, lang string, terms long")
    return frozen(built), shards


class Shard:
    """A perfect hash whose slots are numbered by language, so that a language's slots are a range."""

    def __init__(self, table: PerfectHash):
        split = [(k[: (at := k.rindex(b"\0"))], k[at:]) for k in table.keys.to_pylist()]
        order = np.array(sorted(range(len(split)), key=split.__getitem__), np.int64)
        self.table = table
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.keys = table.keys.take(pa.array(order))
        #: Places of each language, by its stored form.
        self.ranges: dict[bytes, tuple[int, int]] = {}
        for i, k in enumerate(order.tolist()):
            self.ranges[split[k][0]] = (self.ranges.get(split[k][0], (i, i))[0], i + 1)
        self.nbytes = table.nbytes + self.keys.nbytes + 8 * len(order)

    def places(self, hashes: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Place of every key, -1 for one that is not stored."""
        slots = self.table.slots(hashes, keys)
        return np.where(slots < 0, -1, self.place[slots]) if len(self.place) else slots


class ShardCache:
    """Shards of a worker's task, read when needed; the least recently used go beyond `limit` bytes."""

    def __init__(self, paths: dict[int, str], limit: int = CACHE_BYTES):
        self.paths, self.limit, self.held, self.size = paths, limit, OrderedDict(), 0

    def __getitem__(self, shard: int) -> Shard:
        if shard in self.held:
            self.held.move_to_end(shard)
            return self.held[shard]
        fs, local = filesystem(self.paths[shard])
        with fs.open_input_file(local) as source:
            found = Shard(PerfectHash.frombytes(source.read()))
        self.held[shard] = found
        self.size += found.nbytes
        while self.size > self.limit and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].nbytes
        return found


def with_group(docs: DataFrame) -> DataFrame:
    """Append `g`, a number per (lang, source) of the table; the first seed that keeps all groups apart."""
    for seed in range(8):
        marked = docs.withColumn("g", F.xxhash64(F.lit(seed), "lang", "source"))
        groups = marked.select("lang", "source", "g").distinct()
        both = groups.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("apart")).first()
        if both["n"] == both["apart"]:
            return marked
    raise RuntimeError("no seed keeps the groups apart")


def recount(docs: DataFrame, built: DataFrame, shards: int, cache_bytes: int = CACHE_BYTES, dense_bytes: int = DENSE_BYTES) -> DataFrame:
    """Occurrences of every kept term per group: g, shard, slot, n > 0."""
    # One short path per shard of SHARD_KEYS terms: 0.01 bytes a kept term.
    paths = {r.shard: r.path for r in built.select("shard", "path").distinct().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, size = ShardCache(paths, cache_bytes), 0
        # Per (language, shard): number of each group's row, and the dense counts of the rows.
        rows: dict[tuple, dict[int, int]] = {}
        dense: dict[tuple, np.ndarray] = {}
        for batch, texts in text_batches(batches, "text", COUNT_BYTES):
            # A group has one language.
            group, groups = _numbered(batch.column(0))
            lang, langs = _numbered(batch.column(1))
            lang_of = np.zeros(len(groups), np.int64)
            lang_of[group] = lang
            terms, owner = _terms(texts)
            code, unique = _numbered(terms)
            width = max(1, len(unique))
            own, code, n = _pairs(group[owner], code, width)
            key_lang, key_code, _ = _pairs(lang_of[own], code, width)
            if not len(key_code):
                continue
            hashes, keys = _keys(langs, key_lang, unique, key_code)
            shard = (hashes % np.uint64(shards)).astype(np.int64)
            place = np.full(len(keys), -1, np.int64)
            first = np.zeros(len(keys), np.int64)
            names = [x.encode("utf-8", "surrogatepass") for x in langs.to_pylist()]
            widths = {}
            order = np.lexsort((key_lang, shard))
            for part in _runs(order, shard):
                if (number := int(shard[part[0]])) in paths:
                    found = cache[number]
                    place[part] = found.places(hashes[part], keys.take(pa.array(part)))
                    for k in np.unique(key_lang[part]).tolist():
                        first[part[key_lang[part] == k]], end = found.ranges.get(names[k], (0, 0))
                        widths[k, number] = end - found.ranges.get(names[k], (0, 0))[0]
            # Back from the different keys to the counted (group, term) pairs.
            at = np.searchsorted(key_lang * width + key_code, lang_of[own] * width + code)
            hit = np.flatnonzero(place[at] >= 0)
            own, at, n = own[hit], at[hit], n[hit]
            ids = groups.to_numpy()
            order = np.lexsort((key_lang[at], shard[at]))
            for part in _runs(order, shard[at] * len(langs) + key_lang[at]):
                k, number = int(key_lang[at[part[0]]]), int(shard[at[part[0]]])
                cell = (names[k], number)
                numbers = rows.setdefault(cell, {})
                present = np.unique(own[part])
                lines = np.array([numbers.setdefault(int(g), len(numbers)) for g in ids[present]])
                counts = dense.get(cell, np.zeros((0, widths[k, number]), np.int64))
                if len(numbers) > len(counts):
                    more = np.zeros((max(len(numbers), 2 * len(counts)) - len(counts), counts.shape[1]), np.int64)
                    size += more.nbytes
                    counts = dense[cell] = np.concatenate((counts, more))
                counts[lines[np.searchsorted(present, own[part])], place[at[part]] - first[at[part]]] += n[part]
            if size > dense_bytes:
                yield from _nonzero(rows, dense, cache)
                rows, dense, size = {}, {}, 0
        yield from _nonzero(rows, dense, cache)

    found = docs.select("g", "lang", "text").mapInArrow(count, "g long, cell long, n long")
    # A task's counts are already summed, so they move before they are added up.
    counted = found.repartition("cell").groupBy("g", "cell").agg(F.sum("n").alias("n"))
    slot = F.col("cell").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return frozen(counted.select("g", F.shiftright("cell", 32).cast("int").alias("shard"), slot.alias("slot"), "n"))


def _runs(rows: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """`rows`, already in the order of key[rows], split where the key changes."""
    return np.split(rows, np.flatnonzero(np.diff(key[rows])) + 1) if len(rows) else []


def _nonzero(rows: dict, dense: dict, cache: ShardCache) -> Iterator[pa.RecordBatch]:
    """The counts above zero of all dense arrays."""
    for (lang, number), counts in dense.items():
        ids = np.array(list(rows[lang, number]), np.int64)
        line, column = np.nonzero(counts)
        cell = (number << 32) + cache[number].ranges[lang][0] + column
        columns = [pa.array(ids[line]), pa.array(cell.astype(np.int64)), pa.array(counts[line, column])]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "cell", "n"])


# --- divergences ----------------------------------------------------------------------------------


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(STEPS * (count + 2) / (total + 2 * terms)), by long division in steps of 1000."""
    over, rest, out = total + 2 * terms, counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(paths: dict[int, str], top: int, tile: int):
    """Task function: one shard of one language, the sources of two tiles."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        shard, lang, low, high = (table.column(c)[0].as_py() for c in ("shard", "lang", "low", "high"))
        terms, vocabulary = int(get("terms").max()), int(get("vocabulary").max())
        number, slot, n, total = get("number"), get("slot"), get("n"), get("total")
        heads = np.flatnonzero(slot < 0)
        sources = number[heads]
        stored = ShardCache(paths)[shard]
        first, end = stored.ranges[lang.encode("utf-8", "surrogatepass")]
        assert end - first == terms, (shard, lang, end - first, terms)
        counts = np.zeros((len(sources), terms), np.int64)
        order = np.argsort(sources)
        body = np.flatnonzero(slot >= 0)
        at = order[np.searchsorted(sources[order], number[body])]
        counts[at, slot[body] - first] = n[body]
        p = np.stack([shares(c, int(t), vocabulary) for c, t in zip(counts, total[heads])])
        mine, theirs, value, item = [], [], [], []
        tiles = sources // tile
        for i in np.flatnonzero((tiles == low) & (sources >= 0)).tolist():
            others = np.flatnonzero((tiles == high) & (sources >= 0) & ((sources > sources[i]) if low == high else True))
            sums = divergence(p[i][None, :], p[others]).sum(1)
            mine += [int(sources[i])] * len(others)
            theirs += sources[others].tolist()
            value += sums.tolist()
            item += [None] * len(others)
        if low == high:
            whole = p[np.flatnonzero(sources == WHOLE)[0]]
            for i in np.flatnonzero(sources >= 0).tolist():
                found = np.flatnonzero((counts[i] > 0) & (p[i] > whole))
                f = divergence(p[i][found], whole[found])
                if len(found) > top:
                    # Ties with the last value stay until the terms decide.
                    least = np.partition(f, len(f) - top)[len(f) - top]
                    found, f = found[f >= least], f[f >= least]
                prefix = len(lang.encode("utf-8", "surrogatepass")) + 1
                words = [stored.keys[first + int(j)].as_py()[prefix:] for j in found]
                ranked = sorted(zip((-f).tolist(), words))[:top]
                mine += [int(sources[i])] * len(ranked)
                theirs += [WHOLE] * len(ranked)
                value += [-v for v, _ in ranked]
                item += [w.decode() for _, w in ranked]
        return pa.table({
            "lang": pa.array([lang] * len(mine), pa.string()), "mine": pa.array(mine, pa.int32()),
            "theirs": pa.array(theirs, pa.int32()), "term": pa.array(item, pa.string()), "value": pa.array(value, pa.int64()),
        })

    return run


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_keys: int = SHARD_KEYS, tile: int = TILE,
    cache_bytes: int = CACHE_BYTES, dense_bytes: int = DENSE_BYTES,
) -> DataFrame:
    """How far the sources of each language are apart, and the terms that mark each source.

    Returns lang, source, part, item, value, rank.  Part `pair`: every other source of the language
    with the sum of the divergences of all kept terms.  Part `term`: the source's terms whose share
    is above the language's, the `top` most diverging ones.
    """
    docs = with_group(plain(docs))
    kept = kept_terms(docs, min_docs)
    built, shards = build_shards(kept, shard_keys)
    paths = {r.shard: r.path for r in built.select("shard", "path").distinct().collect()}
    counts = recount(docs, built, shards, cache_bytes, dense_bytes)

    spoken = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"))
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = (
        docs.select("lang", "source", "g").distinct()
        .join(totals, "g", "left").join(spoken, "lang", "left").fillna(0, ["total", "vocabulary"])
        .withColumn("number", (F.row_number().over(by_name) - 1).cast("int"))
    )
    groups = frozen(groups)
    tiles = groups.groupBy("lang").agg(F.max(F.floor(F.col("number") / tile)).cast("int").alias("last"), F.sum("total").alias("whole"))

    # One header per (source, shard of its language), also where the source has no term there.
    parts = built.select("shard", "lang", "terms")
    whole = tiles.select("lang", F.lit(WHOLE).alias("number"), F.col("whole").alias("total"))
    heads = groups.select("lang", "number", "total").unionByName(whole).join(parts.select("lang", "shard"), "lang")
    heads = heads.select("lang", "shard", "number", F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("n"), "total")
    body = counts.join(groups.select("g", "lang", "number"), "g").select("lang", "shard", "number", "slot", "n")
    sums = body.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")).withColumn("number", F.lit(WHOLE))
    body = body.unionByName(sums.select(*body.columns)).withColumn("total", F.lit(0).cast("long"))
    rows = heads.unionByName(body.select(*heads.columns)).join(tiles.select("lang", "last"), "lang")
    rows = rows.join(parts, ["lang", "shard"]).join(spoken, "lang")

    # Every tile of sources meets every other once; the language's own counts go to each tile's own pair.
    own = F.floor(F.col("number") / tile).cast("int")
    every = F.sequence(F.lit(0), F.col("last"))
    meets = F.when(F.col("number") == WHOLE, F.transform(every, lambda t: F.struct(t.alias("low"), t.alias("high")))).otherwise(
        F.transform(every, lambda t: F.struct(F.least(t, own).alias("low"), F.greatest(t, own).alias("high")))
    )
    dealt = rows.withColumn("pair", F.explode(meets)).select("shard", "lang", "pair.low", "pair.high", "number", "slot", "n", "total", "terms", "vocabulary")
    found = frozen(
        dealt.groupBy("shard", "lang", "low", "high").applyInArrow(_compare(paths, top, tile), "lang string, mine int, theirs int, term string, value long")
    )

    named = groups.select("lang", "number", "source")
    summed = found.filter(F.col("theirs") >= 0).groupBy("lang", "mine", "theirs").agg(F.sum("value").alias("value"))
    both = summed.unionByName(summed.select("lang", F.col("theirs").alias("mine"), F.col("mine").alias("theirs"), "value"))
    silent = groups.filter(F.col("vocabulary") == 0).select("lang", "number")
    zero = silent.withColumnRenamed("number", "mine").join(silent.withColumnRenamed("number", "theirs"), "lang").filter("mine <> theirs")
    both = both.unionByName(zero.withColumn("value", F.lit(0).cast("long")))
    pairs = both.join(named.withColumnRenamed("number", "mine"), ["lang", "mine"]).join(
        named.select("lang", F.col("number").alias("theirs"), F.col("source").alias("item")), ["lang", "theirs"]
    )
    marks = found.filter(F.col("theirs") < 0).join(named.withColumnRenamed("number", "mine"), ["lang", "mine"])
    columns = ["lang", "source", "part", "item", "value"]
    out = pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        marks.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return out.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
