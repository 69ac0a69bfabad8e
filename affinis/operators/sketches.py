"""Bloom filters and Flajolet-Martin counts on arithmetic hashes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions import hashes, residue, trailing_zeros

# The hash families' multipliers and offsets.
BLOOM_A, BLOOM_B = range(1, 100, 7), range(1, 20, 7)
FM_A, FM_B = range(1, 80, 2), range(1, 20, 7)


def positions(text, bits: int, k: int):
    return F.slice(hashes(residue(text), BLOOM_A, BLOOM_B, bits), 1, k)


def bloom_size(distinct: int, bits: int) -> int:
    """How many hashes suit so many values: bits / values * ln 2, at least 1, as far as the family goes."""
    return max(1, min(len(BLOOM_A) * len(BLOOM_B), int(bits / max(1, distinct) * math.log(2))))


def bloom_build(values: DataFrame, column: str, bits: int = 3000) -> tuple[DataFrame, int]:
    """((position) of set bits, at most `bits` rows; number of hashes) for the non-empty values."""
    v = values.select(F.col(column).alias("s")).where("s <> ''").distinct()
    k = bloom_size(v.count(), bits)
    return v.select(F.explode(positions(F.col("s"), bits, k)).alias("position")).distinct(), k


def bloom_probe(probes: DataFrame, column: str, built: tuple[DataFrame, int], bits: int = 3000) -> DataFrame:
    """probes with hit 1 or 0; an empty or null value reads as None."""
    on, k = built
    # at most `bits` numbers
    filled = on.groupBy().agg(F.collect_list("position").alias("on"))
    own = positions(F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("None")), bits, k)
    return probes.join(F.broadcast(filled), F.lit(True)).withColumn("hit", F.when(F.size(F.array_except(own, "on")) == 0, 1).otherwise(0)).drop("on")


def fm_rows(df: DataFrame, text: str, modulus: int, *keys) -> DataFrame:
    """(keys, i, r): the most trailing zeros of each hash."""
    rows = df.select(*keys, F.col(text).alias("s")).distinct().select(*(k if isinstance(k, str) else k for k in keys), F.posexplode(hashes(residue(F.col("s")), FM_A, FM_B, modulus)).alias("i", "h"))
    return rows.groupBy(*keys, "i").agg(F.max(trailing_zeros(F.col("h"))).alias("r"))


def fm_estimate(df: DataFrame, text: str, groups: int = 20, modulus: int = 3477, *keys) -> DataFrame:
    """(keys, estimate): the median over groups of hashes of the mean of 2^r."""
    size = len(FM_A) * len(FM_B) // groups
    by = fm_rows(df, text, modulus, *keys).groupBy(*keys, F.floor(F.col("i") / size).alias("g")).agg(F.avg(F.pow(F.lit(2.0), F.col("r"))).alias("m"))
    return by.groupBy(*keys).agg(F.median("m").alias("estimate"))


def distinct_sketch(df: DataFrame, column: str, *keys) -> DataFrame:
    """(keys, sketch): a HyperLogLog sketch of each group, to be merged and read by merged_distinct."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column).alias("sketch"))


def merged_distinct(sketches: DataFrame, *keys) -> DataFrame:
    """(keys, n): the estimated distinct values of all sketches of a group together."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def bloom_flags(probes: DataFrame, column: str, built: tuple[DataFrame, int], row: str, bits: int = 3000) -> DataFrame:
    """(row, hit) of each probe; row tells the input order, such as sources.numbered gives."""
    return bloom_probe(probes, column, built, bits).select(row, "hit")
