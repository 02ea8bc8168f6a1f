"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``; only where that is unset in a local
    session, as in tests, a temporary folder is made and set. On a cluster an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidewake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a step is written: its shuffle files go when it has ended, as nothing else reads them. Few rows
#: meet in an Arrow batch, as rows can hold long texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, name: str, batch_rows: int = 256) -> DataFrame:
    """``df`` written once to the shared folder and read back: it survives the loss of executors and cuts lineage.

    ``batch_rows`` rows meet in an Arrow batch of the plan that is written.
    """
    spark = df.sparkSession
    confs = WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
    path, before = fresh_path(spark, name), {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def forget(*steps: DataFrame) -> None:
    """Deletes the files of ``steps``, which ``written`` returned and nothing reads any more; others are left alone."""
    for df in steps:
        path = getattr(df, "step_path", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` in a table in the shared folder, bucketed by ``key``: joins and groups by it don't shuffle it. Dropped at the end."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"tidewake_{uuid.uuid4().hex}", fresh_path(spark, "buckets")
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.step_path = path
    try:
        yield out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget(out)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % mod


def schema_of(df: DataFrame) -> str:
    """The columns of ``df`` as DDL."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before them where ``df`` has such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most about ``most`` text bytes (always one row at least)."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)
