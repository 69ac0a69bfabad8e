"""Set similarity joins and text profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.checkpoints import cut
from affinis.functions import PRIME, WIDE, hashes, jaccard
from affinis.operators import tiles
from affinis.operators.stats import dense_codes, without_words, word_rows

WHOLE = ("tinyint", "smallint", "int", "bigint")  # kinds of items that are whole numbers


def numbered(pair_rows: DataFrame) -> DataFrame:
    """pair_rows with items that are whole numbers: their own, or codes."""
    return pair_rows if pair_rows.schema["item"].dataType.simpleString() in WHOLE else coded(pair_rows)


def tiled(pair_rows: DataFrame) -> tuple[DataFrame, int]:
    """pair_rows, computed once, and the number of blocks to deal their keys into (see tiles), or 0 where a join costs less."""
    once = cut(pair_rows)
    n, keys, joined, _ = tiles.load(once, "key", "item")
    return (numbered(once), tiles.blocks_for(n, keys)) if tiles.pays(n, keys, joined) else (once, 0)


def pair_counts(pair_rows: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, common) for keys a < b with at least `least` common items: by tiles where items are common, else by one equi-join on the
    item."""
    pair_rows, blocks = tiled(pair_rows)
    if blocks:
        find = tiles.counted(lambda c, na, nb: c >= least)
        return tiles.joined(pair_rows, "key", "item", blocks, find, "common long, both long").select("a", "b", "common")
    return joined_counts(pair_rows).where(F.col("common") >= least)


def joined_counts(pair_rows: DataFrame) -> DataFrame:
    """(a, b, common) for keys a < b with common items, by one equi-join on the item."""
    other = pair_rows.select(F.col("key").alias("b"), "item")
    return pair_rows.select(F.col("key").alias("a"), "item").join(other, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


def with_jaccard(counts: DataFrame, pair_rows: DataFrame, least: float, places: int | None = None) -> DataFrame:
    n = pair_rows.groupBy("key").agg(F.count("*").alias("n"))
    both = counts.join(n.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    found = both.select("a", "b", jaccard(F.col("common"), F.col("na"), F.col("nb")).alias("sim")).where(F.col("sim") >= least)
    return found if places is None else found.withColumn("sim", F.round("sim", places))


def jaccard_join(pair_rows: DataFrame, least: float, places: int | None = None) -> DataFrame:
    """(a, b, sim) with Jaccard similarity of at least `least`, exact, and then rounded to so many places."""
    pair_rows, blocks = tiled(pair_rows)
    if blocks:
        return tiles.joined(pair_rows, "key", "item", blocks, tiles.alike(least, places), "sim double")
    return with_jaccard(joined_counts(pair_rows), pair_rows, least, places)


def coded(pair_rows: DataFrame) -> DataFrame:
    """pair_rows with items of any kind as whole numbers from 0 on, in their order."""
    return pair_rows.join(dense_codes(pair_rows, "item"), F.col("item") == F.col("value")).select("key", F.col("code").alias("item"))


def lsh_candidates(pair_rows: DataFrame, modulus: int, a_range: range, b_range: range, rows: int = 1, prime: int = PRIME) -> DataFrame:
    """(a, b), a < b: keys that share a band of `rows` MinHash values; items are whole numbers (see coded)."""
    signature = signatures(pair_rows, modulus, a_range, b_range, rows, prime)
    bands = signature.groupBy("key", F.floor(F.col("i") / rows).alias("band")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("s"))
    other = bands.select(F.col("key").alias("b"), "band", "s")
    return bands.select(F.col("key").alias("a"), "band", "s").join(other, ["band", "s"]).where("a < b").select("a", "b").distinct()


def signatures(pair_rows: DataFrame, modulus: int, a_range: range, b_range: range, rows: int = 1, prime: int = PRIME) -> DataFrame:
    """(key, i, h): MinHash values, as many as fill bands of `rows`; items are whole numbers."""
    n = len(a_range) * len(b_range) // rows * rows
    values = pair_rows.select("key", F.posexplode(hashes(F.col("item"), a_range, b_range, modulus, prime)).alias("i", "h")).where(F.col("i") < n)
    return values.groupBy("key", "i").agg(F.min("h").alias("h"))


def dense_lsh(pair_rows: DataFrame, modulus: int, a_range: range, b_range: range, rows: int = 1, prime: int = PRIME) -> DataFrame | None:
    """(key, sig): each key's MinHash values, where the bands part so little that it costs less to look at all pairs and keep those
    that share a band; else None."""
    n = len(a_range) * len(b_range) // rows * rows
    least = [F.min(((F.col("item") * a + b) % prime) % modulus) for a in a_range for b in b_range][:n]
    sig = cut(pair_rows.groupBy("key").agg(F.array(*least).alias("sig")))
    each = F.explode(F.sequence(F.lit(0), F.lit(n // rows - 1))) if n else F.explode(F.array().cast("array<int>"))
    bands = sig.select(each.alias("band"), "sig").groupBy("band", F.slice("sig", F.col("band") * rows + 1, rows).alias("s")).agg(F.count("*").alias("n"))
    met, keys = bands.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0, sig.count()
    return sig if n and met > keys * (keys - 1) / 2 else None


def lsh_join(pair_rows: DataFrame, least: float, modulus: int, a_range: range, b_range: range, rows: int = 1, prime: int = PRIME, places: int | None = None) -> DataFrame:
    """The pairs of jaccard_join that are lsh_candidates; items are whole numbers (see coded)."""
    pair_rows, blocks = tiled(pair_rows)
    if blocks and (sig := dense_lsh(pair_rows, modulus, a_range, b_range, rows, prime)) is not None:
        return tiles.joined(pair_rows, "key", "item", blocks, tiles.banded(tiles.alike(least, places), rows), "sim double", extra=sig)
    found = lsh_candidates(pair_rows, modulus, a_range, b_range, rows, prime)
    common = pair_rows.select(F.col("key").alias("a"), "item").join(found, "a").join(pair_rows.select(F.col("key").alias("b"), "item"), ["b", "item"])
    return with_jaccard(common.groupBy("a", "b").agg(F.count("*").alias("common")), pair_rows, least, places)


def tfidf(df: DataFrame, key: str, text: str, stopwords, k: int, rare: float = 1e-6, compat: bool = False) -> DataFrame:
    """(key, word, score): each key's k best words by tf / max tf * log2(keys / df), ties by word; compat: tf * (log2(keys / df) / max tf)^tf.
    stopwords: a list or a table (word)."""
    counts = without_words(word_rows(df.withColumnRenamed(key, "key"), text, "key", signs=WIDE), stopwords).groupBy("key", "word").agg(F.count("*").alias("tf"))
    whole = counts.groupBy("word").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    # the corpus total is one number
    whole = whole.join(F.broadcast(whole.agg(F.sum("n").alias("total"))), F.col("n") >= F.col("total") * rare).select("word", "df")
    keys = F.broadcast(df.agg(F.count_distinct(key).alias("keys")))
    most = counts.groupBy("key").agg(F.max("tf").alias("most"))
    scored = counts.join(whole, "word").join(most, "key").join(keys, F.lit(True))
    rarity = F.log2(F.col("keys") / F.col("df"))
    scored = scored.withColumn("score", F.col("tf") * F.pow(rarity / F.col("most"), F.col("tf")) if compat else F.col("tf") / F.col("most") * rarity)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.round("score", 9)), "word"))
    return scored.withColumn("r", rank).where(F.col("r") <= k).select("key", "word", "score")


def user_profiles(pair_rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """(key, word): the union of the profiles of a user's items; pair_rows (key, item)."""
    return pair_rows.join(profiles.select(F.col("key").alias("item"), "word"), "item").select("key", "word").distinct()


def content_score(test: DataFrame, users: DataFrame, items: DataFrame, least: float = 0.01) -> DataFrame:
    """(key, item, sim): boolean cosine of the profiles of each test pair; repeated pairs stay."""
    size = lambda df: df.groupBy("key").agg(F.count("*").alias("n"))
    words_of = users.select("key", "word").join(items.select(F.col("key").alias("item"), "word"), "word").groupBy("key", "item").agg(F.count("*").alias("c"))
    sims = words_of.join(size(users), "key").join(size(items).select(F.col("key").alias("item"), F.col("n").alias("m")), "item")
    sims = sims.select("key", "item", (F.col("c") / (F.sqrt("n") * F.sqrt("m"))).alias("sim")).where(F.col("sim") >= least)
    return test.join(sims, ["key", "item"])
