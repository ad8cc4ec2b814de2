"""Main text of web pages: page structure, and a suffix array over the pages of a host.

A page is cut into blocks, the stretches of text between block-level tags (`html_blocks`).  The words of
all blocks of many pages are put end to end, a mark between pages, and their suffixes sorted to the
depth of RUN words, which is all that "RUN words in common" asks (three doublings instead of log(n)):
so every run of words is found with the number of different pages that hold it.  A block of fewer words
is a run of its own.  A run is a template of its host if LEAST_PAGES contents and LEAST_SHARE of them hold it, and
universal if UNIVERSAL_PAGES and UNIVERSAL_SHARE do.  Then

* on a page without a declared article (article, main, role=main) blocks of which templates cover the
  share COVERED go, and unique runs stay;
* on a page with one, only its text stays, and of that the blocks at its beginning and end go that universal
  runs cover.  Text that fewer pages share, such as syndicated prose, stays, also at the edges.

Counting runs over a host takes three passes over the blocks, none of which moves texts.  Pages with the same words
are one content, and the first of them speaks for it.  Each task sorts the suffixes of its own pages, whatever their hosts.
First the tasks' counts are added up in an array of counters per host, by run hash, two per word; a counter
is never below the count of any of its runs.  Then only runs whose counter reaches the threshold are counted by
themselves, exactly, over the host.  A host with a third of all pages is counted by all tasks, and its counters are
cut into ranges.  Tasks read counters and templates of their own pages' hosts from tables sorted by host.

A null or empty page has an empty text.  A null address counts as a host without name.  Repeated rows
are extracted each and count as one content.  Very long pages are parsed in time that follows their length, and taken
alone.  Null ids stay.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.sql import DataFrame, functions as F

from .common import Texts, filesystem, frozen, mix, release, shared_folder, span_hashes
from .html_blocks import BODY, MAIN, blocks

RUN = 6
COVERED = 0.8
#: A run is a template if this many different contents of the host hold it, and this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.02
#: A run is universal from these on; only such runs may take text from a declared article.
UNIVERSAL_PAGES, UNIVERSAL_SHARE = 5, 0.5
#: Bytes of block texts whose suffixes are sorted together, counters of a range, counted runs a task keeps.
SORT_BYTES, RANGE, KEEP = 1 << 20, 1 << 20, 2_000_000


# --- suffixes ---------------------------------------------------------------------------------------


def ranks(words: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Ranks of the suffixes by their first `run` words; a suffix that leaves its page gets rank -1."""
    n = len(words)
    if n < run:
        return np.full(n, -1, np.int64)
    _, rank = np.unique(words, return_inverse=True)
    length = 1
    while length < run:
        step = min(length, run - length)
        whole = np.full(n, -1, np.int64)
        at = np.arange(n - step)
        ok = (rank[at] >= 0) & (rank[at + step] >= 0) & (page[at] == page[at + step])
        key = rank[at[ok]].astype(np.uint64) << np.uint64(32) | rank[at[ok] + step].astype(np.uint64)
        whole[at[ok]] = np.unique(key, return_inverse=True)[1]
        rank, length = whole, length + step
    return rank


def spans(starts: np.ndarray, n: int, run: int = RUN) -> np.ndarray:
    """Which of n words lie in a run that begins at one of `starts`."""
    cover = np.zeros(n + run + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    return np.cumsum(cover)[:n] > 0


class Words:
    """The words of the blocks of several pages: hashes, page and block number of each."""

    def __init__(self, pages: pa.Array):
        """`pages` holds each page's list of block texts."""
        texts = Texts(pages.flatten().cast(pa.large_string()))
        starts, ends, self.block = texts.words()
        self.hashes = span_hashes(texts.buf, starts, ends)
        lengths = pages.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        owner = np.repeat(np.arange(len(pages)), lengths)
        self.page = owner[self.block] if len(starts) else self.block
        self.count = np.bincount(self.block, minlength=int(self.bounds[-1]))
        self.owner = owner

    def contents(self) -> np.ndarray:
        """A hash of each page's words in order; pages with the same words are one content."""
        order = np.zeros(len(self.bounds) - 1, np.uint64)
        place = np.arange(len(self.hashes)) - np.searchsorted(self.page, self.page)
        np.add.at(order, self.page, mix(self.hashes ^ mix(place.astype(np.uint64))))
        return order.view(np.int64)

    def _hash(self, at: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(length):
            h = mix(h ^ self.hashes[at + k]) + np.uint64(k + 1)
        return mix(h ^ np.uint64(length))

    def whole(self) -> np.ndarray:
        """Words at which a run within the page begins."""
        at = np.arange(max(0, len(self.hashes) - RUN + 1))
        return at[self.page[at] == self.page[at + RUN - 1]] if len(at) else at

    def runs(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the runs that begin at these words."""
        return self._hash(at, RUN)

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the blocks of fewer than RUN words."""
        first = np.searchsorted(self.block, np.arange(len(self.count)))
        numbers = np.flatnonzero((self.count > 0) & (self.count < RUN))
        hashes = np.zeros(len(numbers), np.uint64)
        for length in range(1, RUN):
            own = self.count[numbers] == length
            hashes[own] = self._hash(first[numbers[own]], length)
        return numbers, hashes


def counted_runs(words: Words, host: np.ndarray, speaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(host, run hash, pages that hold it) of the pages that speak, from the sorted suffixes of all pages.

    `host` has a number per page; the suffixes of different hosts never share a rank.
    """
    own = mix(words.hashes ^ mix(host.astype(np.uint64))[words.page])
    rank = ranks(own, words.page)
    at = np.flatnonzero((rank >= 0) & speaks[words.page])
    pair = np.unique(rank[at].astype(np.uint64) << np.uint64(32) | words.page[at].astype(np.uint64))
    held = np.bincount((pair >> np.uint64(32)).astype(np.int64))
    known, first = np.unique(rank[at], return_index=True)
    hosts, hashes, n = [host[words.page[at[first]]]], [words.runs(at[first])], [held[known] if len(known) else known]
    numbers, short = words.short()
    page = words.owner[numbers]
    numbers, short, page = numbers[speaks[page]], short[speaks[page]], page[speaks[page]]
    order = np.lexsort((page, short, host[page]))
    short, page = short[order], page[order]
    if len(short):
        new_run = np.concatenate(([True], (short[1:] != short[:-1]) | (host[page[1:]] != host[page[:-1]])))
        new_page = new_run | np.concatenate(([True], page[1:] != page[:-1]))
        hosts.append(host[page[new_run]])
        hashes.append(short[new_run])
        n.append(np.add.reduceat(new_page.astype(np.int64), np.flatnonzero(new_run)))
    return tuple(np.concatenate(x) for x in (hosts, hashes, n))


# --- tables by host ---------------------------------------------------------------------------------


class HostTable:
    """Columns of a stored table, sorted by host, as arrays per host; a task keeps those of its last hosts."""

    def __init__(self, path: str, columns: list[str]):
        store, folder = filesystem(path)
        self.table, self.columns = dataset.dataset(folder, filesystem=store, format="parquet", partitioning=None), columns
        self.held: dict[str, dict[str, np.ndarray]] = {}
        self.size = 0

    def rows(self, hosts: list[str]) -> dict[str, dict[str, np.ndarray]]:
        """By host, its rows' columns; a host without rows is absent."""
        missing = sorted(set(hosts) - self.held.keys())
        if missing and "host" in self.table.schema.names:
            if self.size > KEEP:
                self.held, self.size = {}, 0
                missing = sorted(set(hosts))
            found = self.table.to_table(filter=dataset.field("host").isin(missing), columns=["host", *self.columns]).sort_by("host")
            names = found["host"].to_pylist()
            cuts = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
            arrays = {c: found[c].to_numpy() for c in self.columns}
            for i, j in zip(cuts, [*cuts[1:], len(names)]):
                self.held[names[i]] = {c: x[i:j] for c, x in arrays.items()}
            for host in missing:
                self.held.setdefault(host, {})
            self.size += len(names) + len(missing)
        return {h: self.held[h] for h in set(hosts) if self.held.get(h)}


def _stored(df: DataFrame, *order: str) -> str:
    """Write a table sorted by host and return its folder."""
    path = shared_folder(df.sparkSession)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    return path


# --- counters ---------------------------------------------------------------------------------------


def _counters(words: np.ndarray | int) -> np.ndarray:
    """Counters of a host with so many words: the power of two from twice their number up."""
    return np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * np.asarray(words, np.float64), 1)))).astype(np.int64)


def packed(places: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted places as steps of one byte (255: go on) or, where sparse, as numbers; and counts above one."""
    steps = np.diff(places, prepend=0)
    long, rest = steps // 255, (steps % 255).astype(np.uint8)
    more = np.flatnonzero(n > 1)
    counts = np.concatenate((more, n[more])).astype("<u4").tobytes()
    if long.sum() > 3 * len(places):
        return b"\1" + places.astype("<u4").tobytes(), counts
    out = np.full(int(long.sum()) + len(places), 255, np.uint8)
    out[np.cumsum(long + 1) - 1] = rest
    return b"\0" + out.tobytes(), counts


def unpacked(places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    if places[:1] == b"\1":
        at = np.frombuffer(places, "<u4", offset=1).astype(np.int64)
    else:
        steps = np.frombuffer(places, np.uint8, offset=1)
        at = np.cumsum(steps, dtype=np.int64)[steps != 255]
    n = np.ones(len(at), np.int64)
    more = np.frombuffer(counts, "<u4")
    n[more[: len(more) // 2]] = more[len(more) // 2 :]
    return at, n


class _Sketch:
    """Counters of the runs that a task has counted: (host, place) and number, summed when there are many."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hosts: list[str], host: np.ndarray, place: np.ndarray, n: np.ndarray) -> None:
        number = np.array([self.names.setdefault(h, len(self.names)) for h in hosts], np.int64)
        self.parts.append((number[host], place, n))
        self.size += len(place)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            host, place, n = (np.concatenate(x) for x in zip(*self.parts))
            order = np.lexsort((place, host))
            host, place, n = host[order], place[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (host[1:] != host[:-1]))))
            host, place, n = host[new], place[new], np.add.reduceat(n, new)
            names = list(self.names)
            cuts = np.flatnonzero(np.concatenate(([True], (host[1:] != host[:-1]) | (place[1:] // RANGE != place[:-1] // RANGE))))
            out: list[tuple] = []
            for a, b in zip(cuts, [*cuts[1:], len(host)]):
                out.append((names[host[a]], int(place[a] // RANGE), *packed(place[a:b] % RANGE, n[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                names=["host", "range", "places", "counts"],
            )
        self.__init__()


# --- passes -----------------------------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch, texts: str = "texts") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about SORT_BYTES of block texts."""
    lists = batch.column(batch.schema.get_field_index(texts))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.concatenate(([0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False))))
    cuts = np.flatnonzero(np.diff(sizes[ends] // SORT_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, url, host, uid, html) as lists of blocks, with a hash and the number of their words."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            pages = [blocks(h or "") for h in part.column(4).to_pylist()]
            texts = pa.array([[t for _, t in p] for p in pages], pa.list_(pa.string()))
            kinds = pa.array([[k for k, _ in p] for p in pages], pa.list_(pa.int32()))
            words = Words(texts)
            n = np.bincount(words.page, minlength=len(pages))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pa.array(words.contents()), pa.array(n), kinds, texts],
                names=["page_id", "url", "host", "uid", "content", "words", "kinds", "texts"],
            )
    release()


def _speaking(speakers: str):
    """Which rows of (uid) batches speak for their content."""
    store, folder = filesystem(speakers)
    table = dataset.dataset(folder, filesystem=store, format="parquet", partitioning=None)
    known: dict[int, np.ndarray] = {}

    def of(uid: np.ndarray) -> np.ndarray:
        out = np.zeros(len(uid), bool)
        for part in np.unique(uid >> 33).tolist():
            if part not in known:
                known.clear()
                rows = table.to_table(filter=dataset.field("part") == part, columns=["uids"]).column(0).combine_chunks().flatten()
                known[part] = np.sort(rows.to_numpy(zero_copy_only=False))
            mine = uid >> 33 == part
            at = np.minimum(np.searchsorted(known[part], uid[mine]), max(len(known[part]) - 1, 0))
            out[mine] = known[part][at] == uid[mine] if len(known[part]) else False
        return out

    return of


def _by_host(batches: Iterator[pa.RecordBatch], speakers: str):
    """Per slice of (host, uid, texts) rows: host names, each page's host, its words and whether it speaks."""
    speaks = _speaking(speakers)
    for batch in batches:
        for part in _pieces(batch):
            coded = part.column(0).dictionary_encode()
            host = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            yield coded.dictionary.to_pylist(), host, Words(part.column(2)), speaks(part.column(1).to_numpy())
    release()


def _sketch(speakers: str, sizes: str):
    """Task function: counters of the runs of (host, uid, texts) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, counters = _Sketch(), HostTable(sizes, ["words"])
        for hosts, host, words, speaks in _by_host(batches, speakers):
            found = counters.rows(hosts)
            width = _counters([found[h]["words"][0] for h in hosts])
            owner, runs, n = counted_runs(words, host, speaks)
            sketch.add(hosts, owner, (runs % width[owner].astype(np.uint64)).astype(np.int64), n)
            if sketch.size > KEEP:
                yield from sketch.rows()
        yield from sketch.rows()

    return run


def _least(contents: int) -> float:
    return max(LEAST_PAGES, LEAST_SHARE * contents)


def _hot(table: pa.Table) -> pa.Table:
    """Adds up one range of a host's counters: a bit for each that reaches the threshold."""
    total = np.zeros(RANGE, np.int64)
    for places, counts in zip(table["places"].to_pylist(), table["counts"].to_pylist()):
        at, n = unpacked(places, counts)
        total[at] += n
    places = np.flatnonzero(total >= _least(table["contents"][0].as_py()))
    return pa.table({"host": table["host"][:1], "range": table["range"][:1], "hot": pa.array([packed(places, np.ones(len(places), np.int64))[0]], pa.binary())})


def _exact(speakers: str, sizes: str, hot: str):
    """Task function: (host, run, pages) of the runs whose counter reached the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, ranges = HostTable(sizes, ["words"]), HostTable(hot, ["range", "hot"])
        places: dict[str, np.ndarray] = {}
        for hosts, host, words, speaks in _by_host(batches, speakers):
            found, width = ranges.rows(hosts), counters.rows(hosts)
            at = words.whole()
            numbers, short = words.short()
            page = np.concatenate((words.page[at], words.owner[numbers]))
            runs = np.concatenate((words.runs(at), short))
            reached = np.zeros(len(runs), bool)
            if sum(map(len, places.values())) > KEEP:
                places.clear()
            for i, name in enumerate(hosts):
                if name in found:
                    if name not in places:
                        parts = [r * RANGE + unpacked(x, b"")[0] for r, x in zip(found[name]["range"], found[name]["hot"])]
                        places[name] = np.sort(np.concatenate(parts))
                    mine = np.flatnonzero((host[page] == i) & speaks[page])
                    place = (runs[mine] % np.uint64(_counters(width[name]["words"][0]))).astype(np.int64)
                    known = places[name]
                    reached[mine] = known[np.minimum(np.searchsorted(known, place), len(known) - 1)] == place
            page, runs = page[reached], runs[reached]
            if not len(runs):
                continue
            order = np.lexsort((page, runs, host[page]))
            page, runs = page[order], runs[order]
            new_run = np.concatenate(([True], (runs[1:] != runs[:-1]) | (host[page[1:]] != host[page[:-1]])))
            new_page = new_run | np.concatenate(([True], page[1:] != page[:-1]))
            n = np.add.reduceat(new_page.astype(np.int64), np.flatnonzero(new_run))
            names = pa.array(hosts, pa.string()).take(pa.array(host[page[new_run]]))
            yield pa.RecordBatch.from_arrays([names, pa.array(runs[new_run].view(np.int64)), pa.array(n)], names=["host", "run", "n"])

    return run


def host_templates(parsed: DataFrame) -> str:
    """Store (host, run, universal) of all templates, sorted by host; returns the folder."""
    first = frozen(parsed.groupBy("host", "content").agg(F.min("uid").alias("uid"), F.max("words").alias("words")))
    speakers = shared_folder(parsed.sparkSession)
    by_part = first.groupBy(F.shiftright("uid", 33).alias("part")).agg(F.collect_list("uid").alias("uids"))
    by_part.repartitionByRange("part").sortWithinPartitions("part").write.parquet(speakers)
    hosts = frozen(first.groupBy("host").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("contents")))
    sizes = _stored(hosts, "host")
    rows = parsed.select("host", "uid", "texts")
    counted = rows.mapInArrow(_sketch(speakers, sizes), "host string, range long, places binary, counts binary")
    reached = counted.join(hosts.select("host", "contents"), "host").groupBy("host", "range").applyInArrow(_hot, "host string, range long, hot binary")
    hot = _stored(reached.filter(F.length("hot") > 1), "host", "range")
    found = rows.mapInArrow(_exact(speakers, sizes, hot), "host string, run long, n long")
    summed = found.groupBy("host", "run").agg(F.sum("n").alias("n")).join(hosts.select("host", "contents"), "host")
    contents = F.col("contents")
    templates = summed.filter(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), LEAST_SHARE * contents))
    universal = F.col("n") >= F.greatest(F.lit(UNIVERSAL_PAGES), UNIVERSAL_SHARE * contents)
    return _stored(templates.select("host", "run", universal.alias("universal")), "host", "run")


def _edges(gone: list[bool]) -> list[bool]:
    """Only the marks that reach from the beginning or the end without a gap."""
    first = next((i for i, g in enumerate(gone) if not g), len(gone))
    last = next((i for i, g in enumerate(reversed(gone)) if not g), len(gone))
    return [i < first or i >= len(gone) - last for i in range(len(gone))]


def extract_pages(
    texts: pa.Array, kinds: list[list[int]], templates: list[np.ndarray], universal: list[np.ndarray]
) -> list[tuple[str, int, int, int]]:
    """(text, words that templates cover, words, blocks that only the templates take away) of each page.

    `templates` and `universal` are sorted run hashes of each page's host.
    """
    words = Words(texts)
    at = words.whole()
    run, page = words.runs(at), words.page[at]
    numbers, short = words.short()

    def shares(known_of: list[np.ndarray]) -> np.ndarray:
        """Covered share of every block."""

        def hits(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
            found = np.zeros(len(hashes), bool)
            cuts = np.searchsorted(owner, np.arange(len(kinds) + 1))
            for p, known in enumerate(known_of):
                if len(known):
                    own = hashes[cuts[p] : cuts[p + 1]]
                    found[cuts[p] : cuts[p + 1]] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            return found

        cover = spans(at[hits(run, page)], len(words.hashes))
        share = np.bincount(words.block, weights=cover, minlength=len(words.count)) / np.maximum(words.count, 1)
        share[numbers[hits(short, words.owner[numbers])]] = 1.0
        return share

    plain, strict = shares(templates), shares(universal)
    # A short block that several pages share may be a heading; alone it goes only where most pages have it.
    brief = words.count < RUN
    taken = np.where(brief, strict, plain) >= COVERED
    strict = strict >= COVERED
    out = []
    for p, (kinds_of, texts_of) in enumerate(zip(kinds, texts.to_pylist())):
        b = words.bounds[p]
        wanted = MAIN if MAIN in kinds_of else BODY
        own = [k for k, kind in enumerate(kinds_of) if kind == wanted]
        gone = [bool((strict if wanted == MAIN else taken)[b + k]) for k in own]
        if wanted == MAIN:
            gone = _edges(gone)
        kept = [texts_of[k] for k, g in zip(own, gone) if not g]
        place = slice(b, words.bounds[p + 1])
        out.append(("\n\n".join(kept), int((plain[place] * words.count[place]).sum().round()), int(words.count[place].sum()), sum(gone)))
    return out


def _extracted(templates: str):
    """Task function: the main text of (page_id, url, host, kinds, texts) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HostTable(templates, ["run", "universal"])
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for part in _pieces(batch):
                hosts = part.column(2).to_pylist()
                every, most = {}, {}
                for host, rows in known.rows(hosts).items():
                    runs = rows["run"].view(np.uint64)
                    every[host], most[host] = np.sort(runs), np.sort(runs[rows["universal"]])
                found = extract_pages(
                    part.column(4), part.column(3).to_pylist(), [every.get(h, none) for h in hosts], [most.get(h, none) for h in hosts]
                )
                text = pa.array([f[0] for f in found], pa.string())
                numbers = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), text, pa.array([len(f[0]) for f in found], pa.int64()), *numbers],
                    names=["page_id", "url", "text", "n_chars", "n_words_covered", "n_words_in_blocks", "n_blocks_taken"],
                )
        release()

    return run


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_words_covered, n_words_in_blocks, n_blocks_taken.

    The last one counts blocks that structure alone would have kept.
    """
    rows = pages.select(
        F.col(id_column).alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"),
    ).withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]+)", 1), F.lit(""))))
    kind = rows.schema["page_id"].dataType.simpleString()
    numbered = rows.withColumn("uid", F.monotonically_increasing_id()).select("page_id", "url", "host", "uid", "html")
    parsed = frozen(
        numbered.mapInArrow(
            _parsed,
            f"page_id {kind}, url string, host string, uid long, content long, words long, kinds array<int>, texts array<string>",
        )
    )
    return parsed.select("page_id", "url", "host", "kinds", "texts").mapInArrow(
        _extracted(host_templates(parsed)),
        f"page_id {kind}, url string, text string, n_chars long, n_words_covered long, n_words_in_blocks long, n_blocks_taken long",
    )
