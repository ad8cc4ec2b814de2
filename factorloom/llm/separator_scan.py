"""Documents of flat token files that have no index, found by their end-of-document ids.

Files are cut into fixed blocks, whatever lies at the cuts.  One task per block compares the whole
block with the end id at once; a prefix scan over the blocks' counts and last separators then gives
each document its number and stitches the ones that cross blocks.

Texts are written with special strings as ordinary text, so that only the end of a document gives an end
id.  A null or empty text is its end id alone; a null id stays null; repeated rows are documents of their
own; a very long text is encoded alone and its ids span as many blocks as they need; an empty table
writes no file.  Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import filesystem, frozen, shared_folder, text_batches
from .tokenizer import encoder

BLOCK_IDS = 1 << 21
#: Blocks per group of the two-level scan: no window holds more rows than this or than there are groups.
GROUP_BLOCKS = 4096


def write_flat_files(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    dtype: str = "<u2",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Write each partition's ids, with an end id after each document, as one flat file.

    Returns the files (path, n_bytes) and the order of documents in them (path, ordinal, doc_id).
    A null or empty text is its end id alone.  The order has a row per document, yet its file takes few bytes
    a row, by which Spark would take it for a table to send through the driver: joins with it are merge joins.
    """
    folder = shared_folder(docs.sparkSession)
    top = np.iinfo(np.dtype(dtype)).max

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, uri, done, size = None, "", 0, 0
        for batch, texts in text_batches(batches, "text"):
            if sink is None:
                uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                fs, path = filesystem(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(path)
            ids, _ = encoder(vocabulary, plain=True).encode(texts, end_id)
            if len(ids) and int(ids.max()) > top:
                raise ValueError(f"ids do not fit {dtype}")
            sink.write(ids.astype(dtype).tobytes())
            size += len(ids) * np.dtype(dtype).itemsize
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * n), pa.array(np.arange(done, done + n)), batch.column(0), pa.array([size] * n)],
                names=["path", "ordinal", "doc_id", "bytes_so_far"],
            )
            done += n
        if sink is not None:
            sink.close()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = frozen(rows.mapInArrow(write, f"path string, ordinal long, doc_id {kind}, bytes_so_far long"))
    files = order.groupBy("path").agg(F.max("bytes_so_far").alias("n_bytes"))
    return files, order.drop("bytes_so_far").hint("merge")


def scan(files: DataFrame, end_id: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Every document of the files (path, n_bytes): path, ordinal, start, n_tokens, closed.

    `start` counts ids of the file before the document; `n_tokens` leaves out the end id.  Ids after
    the last end id make a document with `closed` false.  An empty file has no documents.
    """
    width = np.dtype(dtype).itemsize
    blocks = (
        files.withColumn("n_ids", F.floor(F.col("n_bytes") / width))
        .filter("n_ids > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block_ids))))
        .select("path", "n_ids", "block")
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                begin = row["block"] * block_ids
                n = min(block_ids, row["n_ids"] - begin)
                with fs.open_input_file(path) as file:
                    ids = np.frombuffer(file.read_at(n * width, begin * width), dtype)
                at = begin + np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_pylist(
                    [
                        row
                        | {
                            "found": len(at),
                            "last": int(at[-1]) if len(at) else None,
                            "at": at.astype("<i8").tobytes(),
                        }
                    ],
                    pa.schema(
                        [
                            ("path", pa.string()),
                            ("n_ids", pa.int64()),
                            ("block", pa.int64()),
                            ("found", pa.int64()),
                            ("last", pa.int64()),
                            ("at", pa.binary()),
                        ]
                    ),
                )

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = frozen(
        blocks.repartition(tasks, "path", "block").mapInArrow(
            find, "path string, n_ids long, block long, found long, last long, at binary"
        )
    )
    # Prefix scan, first over groups of blocks, then inside each group.
    keyed = scanned.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    groups = keyed.groupBy("path", "group").agg(F.sum("found").alias("found"), F.max("last").alias("last"))
    earlier = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select(
        "path",
        "group",
        F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("group_before"),
        F.max("last").over(earlier).alias("group_last"),
    )
    inside = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        keyed.withColumns(
            {
                "own_before": F.coalesce(F.sum("found").over(inside), F.lit(0)),
                "own_last": F.max("last").over(inside),
            }
        )
        .join(carried, ["path", "group"])
        .select(
            "path",
            "n_ids",
            (F.col("block") == F.floor((F.col("n_ids") - 1) / block_ids)).alias("final"),
            (F.col("group_before") + F.col("own_before")).alias("before"),
            F.coalesce("own_last", "group_last", F.lit(-1).cast("long")).alias("previous"),
            "at",
        )
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["at"], "<i8")
                left = np.concatenate(([row["previous"]], ends)) + 1
                closed = np.ones(len(ends), bool)
                if row["final"] and left[-1] < row["n_ids"]:
                    ends, closed = np.append(ends, row["n_ids"]), np.append(closed, False)
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"]] * n, pa.string()),
                        pa.array(row["before"] + np.arange(n)),
                        pa.array(left[:n]),
                        pa.array(ends - left[:n]),
                        pa.array(closed),
                    ],
                    names=["path", "ordinal", "start", "n_tokens", "closed"],
                )

    return stitched.mapInArrow(
        documents, "path string, ordinal long, start long, n_tokens long, closed boolean"
    )
