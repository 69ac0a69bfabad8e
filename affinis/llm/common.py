"""What the operators of this subpackage share: shared folders, lineage cuts, components, small text helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.graph import connected_components

WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Whole texts are large rows: at most so many at a time go to a Python worker while this lasts; then as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if not 0 < int(was) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset and all runs on this machine, a
    folder of our own; on a cluster it must be set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="affinis-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder now: computed once, and no executor's loss undoes them."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of each row's own; fixed once the result has been cut."""
    return df.withColumn(name, F.monotonically_increasing_id())


def own_name(name: str, taken) -> str:
    """name, or name with underscores after it, so that it is none of the names taken, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def released(spark: SparkSession) -> None:
    """Let the cleaner delete the shuffle files of what has been cut off by now; they would stay until the driver's next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches, rows: int = 256):
    """The same Arrow rows in smaller batches, so that few texts at a time are Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that written() made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id):
    """True for the quarter of the rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labels_of(labels: DataFrame, name: str) -> DataFrame:
    """One row (doc_id, y double) per labelled document; of repeated labels the largest counts, null ids and labels don't."""
    return (
        labels.select("doc_id", F.col(name).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached. Self-loops and nulls are
    ignored; no edges give no rows. No group of neighbours is gathered anywhere."""
    found = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select(F.col("id").alias("node"), "component")
