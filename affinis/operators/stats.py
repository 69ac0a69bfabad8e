"""Counts, means and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.checkpoints import cut
from affinis.functions import NARROW, words


def count_by_year(df: DataFrame, date: str, year: int) -> DataFrame:
    return df.where(F.year(date) == year).agg(F.count("*").alias("n"))


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("n"))


def top_keys(df: DataFrame, key: str, k: int, name: str = "key") -> DataFrame:
    return df.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def keys_over(df: DataFrame, key: str, n: int, name: str = "key") -> DataFrame:
    return df.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("n")).where(F.col("n") > n)


def word_rows(df: DataFrame, text: str, *keys: str, signs: str = NARROW) -> DataFrame:
    return df.select(*keys, F.explode(words(F.col(text), signs)).alias("word"))


def without_words(rows: DataFrame, stopwords) -> DataFrame:
    """rows without those whose word is a stopword: a short list of the caller's, or a table (word) of any size."""
    if isinstance(stopwords, DataFrame):
        return rows.join(stopwords.select("word"), "word", "left_anti")
    return rows.where(~F.col("word").isin(list(stopwords)))


def top_words(df: DataFrame, text: str, stopwords, k: int) -> DataFrame:
    return without_words(word_rows(df, text), stopwords).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def category_avg(df: DataFrame, categories: str, value: str, k: int, sep: str = ",") -> DataFrame:
    """Mean of value by trimmed category of a separated list; null lists have none."""
    rows = df.select(F.explode(F.split(categories, sep)).alias("c"), value)
    return rows.groupBy(F.trim("c").alias("category")).agg(F.avg(value).alias("mean")).orderBy(F.desc(F.round("mean", 6)), "category").limit(k)


def partition_sizes(df: DataFrame, n: int, *key) -> DataFrame:
    """(partition, n): rows in each of n partitions by key, empty ones included."""
    counts = df.repartition(n, *key).groupBy(F.spark_partition_id().cast("long").alias("partition")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").alias("partition")).join(counts, "partition", "left").fillna(0, ["n"])


def top_levels(df: DataFrame, key: str, levels: int) -> DataFrame:
    """Keys with the `levels` highest counts, ties included."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    # ranks of counts, not of keys: far fewer rows meet in the window
    ranks = counts.select("n").distinct().withColumn("level", F.dense_rank().over(Window.orderBy(F.desc("n")))).where(F.col("level") <= levels)
    return counts.join(F.broadcast(ranks), "n").select("key", "n", F.col("level").cast("long").alias("level"))


def hash_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's arithmetic hash falls into the share; the same rows every time."""
    return df.where((F.col(key) * 7919 + 104729) % 149399 < int(149399 * share))


def reservoir(df: DataFrame, key: str, k: int) -> DataFrame:
    """A uniform sample of k rows by priority: the k least arithmetic hashes, ties by key."""
    return df.orderBy((F.col(key) * 7919 + 104729) % 149399, key).limit(k)


def sample_levels(df: DataFrame, key: str, tag: str, k: int, levels: int) -> DataFrame:
    """Tags with the `levels` highest counts in a reservoir of k rows, ties included."""
    return top_levels(reservoir(df, key, k), tag, levels)


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct non-null values in ascending order, numbered from 0 on without gaps. Values are sorted by ranges; what
    one task sees is a count for each range."""
    part, place = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")
    ranged = cut(df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value").select("value", part, place))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ranged.join(F.broadcast(bases), "part").select("value", (F.col("base") + F.col("place")).alias("code"))
