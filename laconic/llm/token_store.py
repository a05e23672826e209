"""Operator 1, token-ID output: Parquet files of token ids in document order.

Layout: one row per document with id, part, first (ids before it in its part), n_tokens and the
list column ids. Rows ascend by id over parts and within each; so the min/max of row groups and of
the page index select documents, and the metadata columns can be read without any ids.
Ids are dictionary encoded (a vocabulary fits one dictionary page), metadata delta encoded.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laconic.llm.common import scratch, sliced, table, texts, typed
from laconic.llm.tokens import encoder

#: Parquet settings: bytes of a row group, bytes and rows of a page, zstd.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 64 << 20, 256 << 10, 1000


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, part, first, n_tokens, ids) in the order of docs; part is the partition."""

    def run(batches):
        of, end, before, part = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0, TaskContext.get().partitionId()
        for batch in sliced(batches):
            coded = [x + end for x in of.stream(texts(batch.column(1)))]
            n = np.array([len(x) // 4 for x in coded], np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            ids = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(coded))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(before + at[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids)],
                names=[id_col, "part", "first", "n_tokens", "ids"],
            )
            before += int(at[-1])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {typed(docs, id_col)}, part long, first long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write them to path in ascending id order.

    Null text is empty: only the end id. A null id sorts first. Rows of equal ids are ordered by
    a hash of their text. An empty table gives an empty file set. Other columns are ignored.
    One shuffle, of the texts; ids go from the tokenizer straight to the files. A lost task is
    written again whole by Spark's commit protocol.
    """
    key = [F.col(id_col), F.xxhash64(text_col)]
    ordered = docs.select(id_col, text_col).repartitionByRange(*key).sortWithinPartitions(*key)
    (
        encode_documents(ordered, tokenizer, end_id, id_col, text_col)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(path)
    )


def read_meta(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens) without reading ids; start counts all ids of the documents before."""
    rows = spark.read.parquet(path)
    return _placed(rows.select(id_col, "part", "first", "n_tokens")).select(id_col, "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id=None, last_id=None, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, ids) of a range of ids; the bounds reach row groups and pages."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.filter(F.col(id_col) >= first_id)
    if last_id is not None:
        rows = rows.filter(F.col(id_col) <= last_id)
    return rows.select(id_col, "n_tokens", "ids")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds start. The sums by part are one row for each written file, whatever the data."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_all")).select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("_before") + F.col("first"))


def checksums(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of stored ids."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return _placed(rows).select(id_col, "start", "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {typed(rows, id_col)}, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return checksums(spark.read.parquet(path))
