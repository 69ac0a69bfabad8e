"""Readers with declared schemas; nothing is inferred, and a malformed line raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "business_id string, user_id string, stars double, text string, date string"
BUSINESS = "business_id string, categories string, state string, city string"
PAIR = "user_id string, business_id string"
ITEM_MODEL, USER_MODEL = "b1 string, b2 string, sim double", "u1 string, u2 string, sim double"
PROFILE = "id string, type string, vector array<int>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def headered_csv(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def points(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec, file) of headerless lines `id,x1,x2,...`; a number that can't be read raises."""
    f = F.split("value", ",")
    return spark.read.text(path).select(f[0].alias("id"), F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda x: x.cast("double")).alias("vec"), F.input_file_name().alias("file"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def socket_json(spark: SparkSession, host: str, port: int, schema: str) -> DataFrame:
    """A stream of JSON lines, with the time each was read."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return lines.select(F.from_json("value", schema).alias("r"), "timestamp").select("r.*", "timestamp")


def file_stream(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number that ascends in the order in which its files are read; a reread of the same files gives the same."""
    return df.withColumn(name, F.monotonically_increasing_id())


def keyword_stream(stream: DataFrame, text: str, words: list[str]) -> DataFrame:
    """The rows of a stream whose text holds one of the words, whatever its case."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return stream.where(hit)
