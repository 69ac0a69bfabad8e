"""Writers of results; all but `report` write from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def profiles(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("type").json(path)


def report(**tables: DataFrame) -> str:
    """One JSON object with each small table's rows under its name."""
    import json

    return json.dumps({k: [json.loads(x) for x in df.toJSON().collect()] for k, df in tables.items()})


def lines(df: DataFrame, path: str) -> None:
    """Rows with an array of members as text lines: 'a', 'b'."""
    df.select(F.array_join(F.transform("members", lambda m: F.concat(F.lit("'"), m.cast("string"), F.lit("'"))), ", ")).write.mode("overwrite").text(path)


def quoted(items, separator: str = ", "):
    return F.array_join(F.transform(items, lambda m: F.concat(F.lit("'"), m.cast("string"), F.lit("'"))), separator)


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """Two sections of text, Candidates and Frequent Itemsets: a paragraph for each size of sets (items array), ('a'),('b'), in order."""

    def section(number: int, title: str, df: DataFrame) -> DataFrame:
        sets = df.select(F.size("items").alias("n"), "items", F.concat(F.lit("("), quoted("items"), F.lit(")")).alias("t"))
        text = sets.groupBy("n").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("items", "t"))), lambda x: x["t"]), ","), F.lit("\n")).alias("value"))
        head = df.sparkSession.createDataFrame([(0, title)], "n int, value string")
        return head.unionByName(text).withColumn("part", F.lit(number))

    both = section(0, "Candidates:", candidates).unionByName(section(1, "Frequent Itemsets:", frequent))
    both.orderBy("part", "n").coalesce(1).select("value").write.mode("overwrite").text(path)


def edge_values(df: DataFrame, path: str) -> None:
    """(u, v, value) as lines ('u', 'v'), value, highest value first."""
    pair = F.concat(F.lit("('"), F.col("u").cast("string"), F.lit("', '"), F.col("v").cast("string"), F.lit("'), "), F.col("value").cast("string"))
    df.orderBy(F.desc("value"), "u", "v").select(pair).write.mode("overwrite").text(path)


def clusters(assigned: DataFrame, rounds: DataFrame, path: str) -> None:
    """The result of bfr: JSON lines (id, cluster) under clusters, and the round report as one headered CSV under rounds."""
    json_lines(assigned, f"{path}/clusters")
    rounds.orderBy("round_id").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/rounds")


def flags(df: DataFrame, path: str, row: str = "row") -> None:
    """The hits of (row, hit) in the order of rows, a line each."""
    df.orderBy(row).select(F.col("hit").cast("string")).write.mode("overwrite").text(path)
