"""The pipeline's stages and the registered queries on small tables."""

import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from factorloom.llm import QUERIES, dart_minhash, quality, toxicity
from factorloom.llm.tokenizer import encoder, vocabulary

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not available")


@needs_tables
def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "null id " * 30, None, None, None), (70001, None, "en", "src1", 0), (70002, "", None, None, 0)],
        docs.schema,
    )
    rows = docs.unionByName(odd).withColumn("kept", F.lit("clash"))
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = rows, stage(spark, rows, LARGER)
        assert after.columns == before.columns and after.schema["doc_id"] == before.schema["doc_id"]
        path = str(tmp_path / name)
        after.write.parquet(path)
        rows = spark.read.parquet(path)
        names.append(name)
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{LARGER}/labels.parquet"))
            toxic = before.filter(model.score(F.col("text")) >= toxicity.THRESHOLD).count()
            assert toxic > 0 and rows.count() == before.count() - toxic
        elif name == "quality_rules":
            assert rows.filter("text IS NULL OR text = ''").count() == 0
            labels = spark.read.parquet(f"{LARGER}/labels.parquet").filter("quality = 1")
            good = before.join(labels, "doc_id", "left_semi")
            lost = good.join(rows, "doc_id", "left_anti").count()
            assert lost <= 0.03 * good.count()
        elif name == "minhash_near_dedup":
            classes = dart_minhash.duplicate_classes(before)
            assert rows.count() == classes.filter("kept").count()
        else:
            words = lambda df: sum(len(WORD.findall(r.text)) for r in df.select("text").collect())
            assert words(rows) == pytest.approx(1.5 * words(before), rel=0.02)
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, LARGER).collect()
    own = encoder(vocabulary("byte_bpe_50k.json")).tokenizer
    texts = [r.text for r in rows.collect()]
    lengths = sorted(len(own.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(p.length for p in pieces) == sum(lengths)
    assert max(p.offset + p.length for p in pieces) == 1024
    assert [*names, corpus_pipeline.STAGES[-1][0]][1:3] == ["quality_rules", "minhash_near_dedup"]


@needs_tables
def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name


@needs_tables
def test_run_is_the_stages_in_a_row(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids_crc32"} <= set(got.columns)
    assert got.count() > 0


@needs_tables
def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@needs_tables
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op2_packing",)])
def test_a_row_for_every_input_row(spark, name):
    table, key = {"op1_html_extract": ("pages", "page_id"), "op5_nn_descent": ("embeddings", "vec_id")}.get(
        name, ("documents", "doc_id")
    )
    want = [r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(want)


@needs_tables
def test_packing_query_carries_checksums(spark):
    pieces = QUERIES["op2_packing"](spark, FOLDER).collect()
    own = encoder(vocabulary("byte_bpe_50k.json")).tokenizer
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20).collect():
        ids = [*own.encode(r.text, add_special_tokens=False).ids, 0]
        for p in pieces:
            if p.doc_id == r.doc_id:
                part = ids[p.start : p.start + p.length]
                assert p.doc_tokens == len(ids) and len(part) == p.length
                assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))


def test_quality_threshold_is_a_constant():
    assert quality.THRESHOLD == -0.06 and quality.BUCKETS == 1 << 14
