"""Packing, token files and the separator scan against plain re-computation."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorloom.llm import common, packing, queries, separator_scan, token_files, tokenizer
from factorloom.llm.common import Texts
from factorloom.llm.tokenizer import encoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")

ROWS = [
    (5, "The cat sat. It's on the mat,\nthe cat said.", "x"),
    (3, "", "x"),
    (3, "", "x"),
    (None, "no id here", None),
    (9, None, "y"),
    (12, "é à la Üb × ÷ 日本 語 <|endoftext|> ", "z"),
    (11, "long words " * 3000, "z"),
    (8, " a  b\n\n c\t\x0bd\r\n's 12 3a_b", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that share names with the operators' own.
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    return df.withColumns({"part": F.lit(1), "start": F.lit("s"), "n_tokens": F.lit(2.5)}).repartition(3)


#: The library's own objects, with nothing changed.
UNTOUCHED = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def ids_of(path, text):
    return UNTOUCHED[path].encode(text or "", add_special_tokens=False).ids


PLAIN = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}
for _plain in PLAIN.values():
    _plain.encode_special_tokens = True


def plain_ids(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_parts_give_the_ids_of_whole_texts(path):
    rng = np.random.default_rng(3)
    alphabet = list(" \n\t.,'ab1éß×÷<|_  ́ÀΣ日")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]
    ids, borders = encoder(path).encode(Texts(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[borders[i] : borders[i + 1]].tolist() == ids_of(path, text), text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_special_strings_are_one_token_anywhere(path):
    rng = np.random.default_rng(4)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", " ", "\n", "a", "b.", "'s", "  ", "É", "漢", "9", "<"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(3000)]
    ids, borders = encoder(path).encode(Texts(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[borders[i] : borders[i + 1]].tolist() == ids_of(path, text), text
    ids, borders = encoder(path, plain=True).encode(Texts(pa.array(texts[:300])))
    for i, text in enumerate(texts[:300]):
        assert ids[borders[i] : borders[i + 1]].tolist() == plain_ids(path, text), text


def test_the_cache_stays_within_its_bytes(monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE_BYTES", 20_000)
    rng = np.random.default_rng(5)
    own = tokenizer.PartEncoder(BYTE)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice(list("abcdefgh"), 3)) for _ in range(300)) + " " + "y" * 3000 for _ in range(3)]
        ids, borders = own.encode(Texts(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == [ids_of(BYTE, t) for t in texts]
        assert own.nbytes <= 20_000


def test_packing_covers_every_id_once(docs):
    pieces = packing.pack(packing.tokenized(docs, BYTE, 0), 64).collect()
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    want = sorted((str(d), [*ids_of(BYTE, t), 0]) for d, t, _ in ROWS)
    got = []
    for (doc_id, n), parts in by_doc.items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist()
        got += [(str(doc_id), ids[k : k + n]) for k in range(0, len(ids), n)]
    assert sorted(got) == want
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        assert len(p.ids) == 4 * p.length
        ends[p.sequence_id] = p.offset + p.length
    total = sum(len(i) for _, i in want)
    assert sorted(ends) == list(range(-(-total // 64)))
    assert all(n == 64 for s, n in ends.items() if s < max(ends))


def test_sequences_join_pieces(docs):
    rows = packing.sequences(packing.pack(packing.tokenized(docs, BYTE, 0), 64)).collect()
    assert all(len(r.ids) == 4 * r.n_ids for r in rows)
    assert sum(r.n_ids for r in rows) == sum(len(ids_of(BYTE, t)) + 1 for _, t, _ in ROWS)


def test_packing_of_an_empty_table(docs):
    assert packing.pack(packing.tokenized(docs.limit(0), BYTE, 0)).count() == 0


def test_token_files_round_trip(docs, monkeypatch):
    manifest = token_files.write_token_files(docs, WORD, 1)
    rows = token_files.read_token_files(manifest).collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for got, (doc_id, text, _) in zip(sorted(rows, key=lambda r: r.start), want, strict=True):
        ids = np.array([*ids_of(WORD, text), 1], "<u4")
        assert (got.doc_id, got.start, got.n_tokens) == (doc_id, start, len(ids))
        assert got.ids_crc32 == zlib.crc32(ids)
        start += len(ids)


def test_only_requested_documents_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    path = tmp_path / "f"
    stored = [(1, np.arange(5)), (2, np.arange(1000)), (2, np.arange(0)), (None, np.arange(100)), (7, np.arange(101))]
    with path.open("wb") as sink:
        writer = token_files.FileWriter(sink)
        for doc_id, ids in stored:
            writer.add(doc_id, ids.astype("<u4"))
        writer.close()
    reader = token_files.FileReader(str(path))
    assert [a.tolist() for a in reader.all()] == [a.tolist() for _, a in stored]
    read = []
    plain = reader._plain
    reader._plain = lambda frame, packed: read.append(frame) or plain(frame, packed)
    found = reader.by_id([2, 7, 99])
    assert [len(a) for a in found[2]] == [1000, 0] and len(found[7][0]) == 101 and 99 not in found
    assert len(read) == 10 + 1 + 2
    data = bytearray(path.read_bytes())
    data[int(reader.at[1]) + 6] ^= 255
    path.write_bytes(data)
    broken = token_files.FileReader(str(path))
    assert broken.ids(0).tolist() == list(range(5))
    with pytest.raises(Exception):
        broken.ids(1)


def test_token_files_of_an_empty_table(docs):
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), WORD, 1)).count() == 0


def test_separator_scan_finds_every_document(docs):
    files, order = separator_scan.write_flat_files(docs, WORD, 49407)
    rows = separator_scan.scan(files, 49407, block_ids=7).join(order, ["path", "ordinal"]).collect()
    want = sorted((str(d), len(plain_ids(WORD, t))) for d, t, _ in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    assert all(r.closed for r in rows)


def test_documents_of_flat_files_are_never_broadcast(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    counts = queries.op10_token_counts(spark, str(tmp_path))
    files, order = separator_scan.write_flat_files(docs, WORD, 49407)
    own = separator_scan.scan(files, 49407).join(order, ["path", "ordinal"])
    for found in (counts, own, own.select("ordinal", "path", "n_tokens").join(order, ["path", "ordinal"])):
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        # One row per file and group of blocks may be sent to all; rows of documents may not.
        joins = [line for line in plan.splitlines() if "Join" in line and "ordinal#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins), plan
        assert sorted(r.n_tokens for r in rows) == sorted(len(plain_ids(WORD, t)) for _, t, _ in ROWS)


def test_separator_scan_stitches_blocks_and_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separator_scan, "GROUP_BLOCKS", 3)
    rng = np.random.default_rng(1)
    files, want = [], []
    for k, (n, share) in enumerate([(1000, 0.02), (1000, 0.5), (64, 0.0), (0, 0.0), (65, 1.0)]):
        ids = np.where(rng.random(n) < share, 9, 1).astype("<u2")
        (tmp_path / f"{k}").write_bytes(ids.tobytes())
        files.append((str(tmp_path / f"{k}"), 2 * n))
        at = [-1, *np.flatnonzero(ids == 9).tolist()]
        found = [(i, a + 1, b - a - 1, True) for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]
        if at[-1] + 1 < n:
            found.append((len(found), at[-1] + 1, n - at[-1] - 1, False))
        want += [(files[-1][0], *f) for f in found]
    got = separator_scan.scan(spark.createDataFrame(files, "path string, n_bytes long"), 9, block_ids=16).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_separator_scan_of_an_empty_table(docs):
    files, order = separator_scan.write_flat_files(docs.limit(0), WORD, 49407)
    assert separator_scan.scan(files, 49407).count() == 0


def test_long_texts_hash_and_encode_like_short_ones(monkeypatch):
    rng = np.random.default_rng(0)
    text = " ".join("".join(rng.choice(list("abcdé"), 6)) for _ in range(9000)) + " " + "x" * 30000
    texts = Texts(pa.array([text]))
    starts, ends, _ = texts.words()
    whole, ids = common.span_hashes(texts.buf, starts, ends), encoder(BYTE).encode(texts)[0]
    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    assert (common.span_hashes(texts.buf, starts, ends) == whole).all()
    assert (encoder(BYTE).encode(texts)[0] == ids).all()
    assert ids.tolist() == ids_of(BYTE, text)
