"""Baskets and frequent itemsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.checkpoints import cut


def pairs(df: DataFrame, key: str, item: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key IS NOT NULL AND item IS NOT NULL").distinct()


def baskets(df: DataFrame, key: str, item: str, over: int = 0) -> DataFrame:
    """(key, items sorted, n) of baskets with more than `over` different items."""
    b = pairs(df, key, item).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return b.withColumn("n", F.size("items").cast("long")).where(F.col("n") > over)


def larger(pair_rows: DataFrame, over: int) -> DataFrame:
    """The pairs of baskets with more than `over` items."""
    keys = pair_rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > over).select("key")
    return pair_rows.join(keys, "key", "left_semi")


def frequent(pair_rows: DataFrame, support: int, size: int) -> list[DataFrame]:
    """Itemsets (i1 < i2 < ..., freq) of 1 to `size` items in at least `support` baskets, level by level.

    Level n joins each basket's frequent (n - 1)-sets with its larger frequent items, so a candidate's prefix is frequent.
    """
    first = pair_rows.groupBy(F.col("item").alias("i1")).agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    kept = cut(pair_rows.join(first.select(F.col("i1").alias("item")), "item", "left_semi").select("key", "item"))
    levels, rows = [first], kept.withColumnRenamed("item", "i1")
    for n in range(2, size + 1):
        names = [f"i{k}" for k in range(1, n + 1)]
        wide = rows.join(kept.withColumnRenamed("item", f"i{n}"), "key").where(F.col(f"i{n - 1}") < F.col(f"i{n}"))
        level = wide.groupBy(*names).agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
        levels.append(level)
        if n < size:
            rows = wide.join(level.select(*names), names, "left_semi").select("key", *names)
    return levels


def local_itemsets(sets: list[list], least: int, size: int) -> list[tuple]:
    """All itemsets of up to `size` items in at least `least` of these baskets, level by level: a set goes on with larger items of the
    baskets that hold it."""
    where: dict = {}
    for n, items in enumerate(sets):
        for i in set(items):
            where.setdefault((i,), set()).add(n)
    now = {s: w for s, w in where.items() if len(w) >= least}
    singles, found = sorted(s[0] for s in now), []
    for n in range(1, size + 1):
        found += sorted(now)
        if n < size:
            grown = ((s + (i,), w & where[(i,)]) for s, w in now.items() for i in singles if i > s[-1])
            now = {s: w for s, w in grown if len(w) >= least}
    return found


def son_candidates(basket_rows: DataFrame, support: int, size: int, at_once: int = 2_000) -> DataFrame:
    """(items): the itemsets that are frequent in a part of the baskets (items array), at the part's share of the support. A part is
    at_once baskets of one partition, so that its memory is bounded. Which sets come depends on the parts; no frequent one is missing."""
    total = basket_rows.count()
    kind = basket_rows.schema["items"].dataType.simpleString()

    def mine(pdfs):
        import pandas as pd

        for pdf in pdfs:
            for at in range(0, len(pdf), at_once):
                part = [list(x) for x in pdf["items"][at : at + at_once]]
                if found := local_itemsets(part, max(1, -(-support * len(part) // total)), size):
                    yield pd.DataFrame({"items": [list(s) for s in found]})

    return basket_rows.select("items").mapInPandas(mine, f"items {kind}").distinct()


def containment_counts(candidates: DataFrame, basket_rows: DataFrame) -> DataFrame:
    """(items, freq): how many baskets (key, items) hold each candidate set (items). Sets meet baskets by one of their items, the one
    in fewest baskets, so that no pair without a common item is looked at."""
    inside = basket_rows.select(F.col("items").alias("basket"), F.explode("items").alias("rarest"))
    often = inside.groupBy("rarest").agg(F.count("*").alias("n"))
    each = candidates.select("items", F.explode("items").alias("rarest")).join(often, "rarest")
    least = each.groupBy("items").agg(F.min(F.struct("n", "rarest")).alias("m")).select("items", F.col("m.rarest").alias("rarest"))
    held = least.join(inside, "rarest").where(F.size(F.array_except("items", "basket")) == 0)
    return held.groupBy("items").agg(F.count("*").alias("freq"))


def son(basket_rows: DataFrame, support: int, size: int) -> DataFrame:
    """(size, items as text, freq): itemsets of up to `size` items in at least `support` baskets, mined part by part, then counted."""
    counted = containment_counts(son_candidates(basket_rows, support, size), basket_rows).where(F.col("freq") >= support)
    return counted.select(F.size("items").cast("long").alias("size"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "freq")


def itemsets(levels: list[DataFrame]) -> DataFrame:
    """(size, items as text, freq) of all levels."""
    shaped = [
        df.select(F.lit(n).cast("long").alias("size"), F.concat_ws(",", *(F.col(f"i{k}").cast("string") for k in range(1, n + 1))).alias("items"), "freq")
        for n, df in enumerate(levels, 1)
    ]
    return reduce(DataFrame.unionByName, shaped)


def grown(bits, support: int, size: int, suffix: tuple, out: list) -> None:
    """Pattern growth: out gets (items, freq) of the frequent sets of up to `size` items that end in suffix. bits: a row for each item
    before it, in whose columns are the baskets that hold the suffix."""
    import numpy as np

    freq = bits.sum(axis=1, dtype=np.int64)
    for k in np.flatnonzero(freq >= support).tolist():
        found = (k, *suffix)
        out.append((found, int(freq[k])))
        if len(found) < size and k:
            grown(bits[:k, bits[k]], support, size, found, out)


def sized_fp_growth(basket_rows: DataFrame, support: int, size: int) -> DataFrame:
    """(items, freq): FP-growth that stops at `size` items. A task has the conditional baskets of a frequent item: what is before it in
    the baskets that hold it. Sets are grown in them from conditional base to conditional base."""
    from pyspark.sql import Window

    kind = basket_rows.schema["items"].dataType.elementType.simpleString()
    # a number of each basket's own: in one select with explode, it would be one of each item's
    each = cut(basket_rows.withColumn("k", F.monotonically_increasing_id()).select("k", F.explode("items").alias("item")))
    often = each.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    # from the most to the least frequent item; a row for each frequent item is in the window
    ranks = cut(often.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "item")).cast("int")))
    kept = each.join(ranks.select("item", "rank"), "item").groupBy("k").agg(F.array_sort(F.collect_list("rank")).alias("r"))
    held = kept.select("r", F.posexplode("r").alias("p", "last")).select("last", F.slice("r", 1, F.col("p")).alias("r"))

    def grow(pdf):
        import numpy as np
        import pandas as pd

        last, lists = int(pdf["last"].iloc[0]), pdf["r"].tolist()
        known = np.unique(np.concatenate(lists)) if any(map(len, lists)) else np.empty(0, np.int32)
        bits = np.zeros((len(known), len(lists)), bool)
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        if len(at):
            bits[np.searchsorted(known, np.concatenate(lists)), at] = True
        out = [((), len(lists))]
        if size > 1:
            grown(bits, support, size - 1, (), out)
        return pd.DataFrame({"ranks": [[*known[list(s)].tolist(), last] for s, _ in out], "freq": [n for _, n in out]})

    sets = held.groupBy("last").applyInPandas(grow, "ranks array<int>, freq long")
    sets = cut(sets).withColumn("set", F.monotonically_increasing_id())
    names = sets.select("set", "freq", F.explode("ranks").alias("rank")).join(F.broadcast(ranks.select("item", "rank")), "rank")
    return names.groupBy("set").agg(F.array_sort(F.collect_list("item")).cast(f"array<{kind}>").alias("items"), F.first("freq").alias("freq")).drop("set")


def fp_growth(basket_rows: DataFrame, support: int, size: int | None = None) -> DataFrame:
    """The same itemsets by FP-growth, of any size, or of at most `size` items without growing larger ones."""
    from pyspark.ml.fpm import FPGrowth

    n = basket_rows.count()
    if n < support:
        return basket_rows.sparkSession.createDataFrame([], "size long, items string, freq long")
    if size is not None:
        sets = sized_fp_growth(basket_rows, support, size)
    else:
        sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(basket_rows).freqItemsets.where(F.col("freq") >= support)
    return sets.select(F.size("items").cast("long").alias("size"), F.array_join(F.transform(F.array_sort("items"), lambda i: i.cast("string")), ",").alias("items"), "freq")
