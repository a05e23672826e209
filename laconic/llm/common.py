"""What the training-data operators share: tables, scratch tables and Arrow mapping."""

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir.

    Only a session in one local process may lack the setting; it then gets a temporary folder.
    The path is removed when the driver's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_scratch.setdefault(context.applicationId, "")
        if not base:
            base = _local_scratch[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="laconic-")
    path = f"{base.rstrip('/')}/laconic-{tag}-{uuid.uuid4().hex}"
    jvm = context._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: later stages reread it, even after executors were lost."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by written(), once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = context._jvm.org.apache.hadoop.fs.Path(name)
        if "/laconic-" in name:
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def typed(df: DataFrame, column: str) -> str:
    """The DDL type of a column."""
    return df.schema[column].dataType.simpleString()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def sliced(batches, rows: int = 1000):
    """Arrow batches in slices of so many rows, so that no more texts than these are Python objects at once."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def crc_mod(column, n: int):
    """crc32 of a value's text, modulo n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % n
