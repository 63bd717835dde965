"""Spark helpers that the operators share: inputs, shared folders, checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Label rows (two small columns) up to which a side is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()

#: Most rows and bytes of an Arrow batch: a worker's memory is a multiple of these, whatever the partition's size.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python can import it; bound the batches they get."""
    for name, most in ARROW.items():
        now = str(spark.conf.get(name))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    if (app := spark.sparkContext.applicationId) not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/anchorite", "zip", root, "anchorite"))
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, else a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='anchorite-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where



#: Spark removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage is cut and lost executors cost nothing.

    The shuffle files of the write go with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames_: DataFrame) -> None:
    """Delete stored frames that nothing reads any more: their successors are written."""
    for df in frames_:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_labels(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Left join of one label row for each doc_id; broadcast only if its row count is small."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).alias(c) for c in columns])
    if labels.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    return docs.join(one, "doc_id", "left")


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts


def hashed_order(column: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(column))


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, do not matter."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def batch(ddl: str, *columns) -> pa.RecordBatch:
    s = schema(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, s, strict=True)], schema=s)
