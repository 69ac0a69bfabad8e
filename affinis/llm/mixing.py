"""Mixing sources to target weights, with DataFrame functions only.

Words are the tokens. The words of a source, document after document in a pseudorandom but fixed order, are packed into blocks
of a fixed number of words (a source's last block may be shorter). The mix has as many slots as bring all targets, dealt over
output shards of SLOTS slots. Each slot of a shard draws its source by the targets' shares, in a stratified multinomial draw: slot i of n
draws from the i-th of n equal stretches of the shares, which leaves a shard's count of a source random but less than two slots
from its expectation. The slots that a source drew are numbered shard after shard. Number j of a source with n blocks
stands for block p(j mod n) of pass j div n, where p is a pseudorandom permutation of the source's block numbers (a swap-or-not
network, a permutation for every n); slots and documents then meet by block number.

Sources in code point order, null last, weigh 3, 1, 2, 3, 1, 2, ... and share 150 % of all words; no target exceeds twice its
source's words: what would exceed it is reshared by weight among the others. Slots that a source draws beyond twice its blocks stay
empty, so no block is taken more than twice, and no document either. Null and empty texts have size 0 and are taken 0 times;
repeated rows count each; reruns agree. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import WORD, cut, partitions, table

BLOCK, ROUNDS, SLOTS, CELLS, SMALL = 64, 6, 16_384, 4096, 50_000
WEIGHTS = (3.0, 1.0, 2.0)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, skey, h, th): words of whole texts; skey tells a null source from any other; h orders documents."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("h"),
        F.xxhash64("text").alias("th"),
    )


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(skey, source_size, target, blocks, slots, mirrors), a row per source: weights water-filled under the caps."""
    per = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    capped = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    earlier, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (everything - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(onward)
    # sources are filled from the least cap for its weight on; the first that isn't full sets the level for the rest
    filled = capped.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "skey", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest)
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), 2 * F.col("blocks")))
    mirrors = F.array(*(hex_number(F.concat_ws(":", F.col("skey"), F.lit(r))) for r in range(ROUNDS)))
    return filled.withColumn("target", target).withColumn("blocks", blocks).select(
        "skey", "source_size", "target", "blocks", slots.alias("slots"), mirrors.alias("mirrors")
    )


def hex_number(text, digits: int = 8):
    """The first hexadecimal digits of md5 of text, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def permuted(slots: DataFrame) -> DataFrame:
    """slots (skey, slot, blocks, mirrors, ...) with block: where the swap-or-not network sends slot mod blocks."""
    n = F.col("blocks")

    def swap(x, mirror):
        y = (mirror + n - x) % n
        coin = F.substring(F.md5(F.concat_ws(":", F.col("skey"), mirror, F.greatest(x, y)).cast("binary")), 1, 1) >= "8"
        return F.when(coin, y).otherwise(x)

    return slots.withColumn("block", F.aggregate("mirrors", F.col("slot") % n, swap))


def sided(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows; they are counted."""
    return F.broadcast(df) if rows <= SMALL else df


def mixture(plan: DataFrame, shard_slots: int = SLOTS) -> DataFrame:
    """(shard, skey, slot, block): every filled slot of the mix, the output shard that drew it, and the block that fills it."""
    spark = plan.sparkSession
    sources, total = plan.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    after = F.sum("slots").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0))
    ends = cut(plan.where("slots > 0").withColumn("end", after).select("skey", "blocks", "mirrors", (F.col("end") - F.col("slots")).alias("begin"), "end"))
    cell = lambda x: F.floor(x * F.lit(CELLS) / F.lit(max(1, total))).cast("long")
    ranges = ends.select("skey", "begin", "end", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end") - 1))).alias("cell"))
    slots = spark.range(0, total, 1, max(partitions(spark), total // 1_000_000)).select(F.col("id").alias("at"), F.floor(F.col("id") / shard_slots).alias("shard"))
    size = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots).cast("double")
    part = (F.col("at") - F.col("shard") * shard_slots).cast("double") + hex_number(F.concat_ws("/", "shard", "at")).cast("double") / F.lit(float(1 << 32))
    drawn = slots.withColumn("u", F.least(F.floor(part / size * F.lit(float(total))).cast("long"), F.lit(total - 1))).withColumn("cell", cell(F.col("u")))
    drawn = drawn.join(sided(ranges, sources + CELLS), "cell").where("begin <= u AND u < end").select("shard", "skey", "at")
    counts = drawn.groupBy("skey", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("skey", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("skey", "shard").orderBy("at")
    numbered = drawn.withColumn("place", F.row_number().over(within) - 1).join(bases, ["skey", "shard"])
    taken = numbered.select("shard", "skey", (F.col("base") + F.col("place")).alias("slot")).join(sided(ends.select("skey", "blocks", "mirrors"), sources), "skey")
    return permuted(taken.where(F.col("slot") < 2 * F.col("blocks"))).select("shard", "skey", "slot", "block")


def placed(sized: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """sized with start, the words of its source before it. Order: h, doc_id, size, th; cut into chunks by the leading digits of h,
    whose totals are summed first, so that no source's rows meet in one task; source_size and target come along."""
    chunks = max(1, min(1 << 20, sized.count() // 4000))
    sized = sized.withColumn("chunk", F.floor(F.conv(F.substring("h", 1, 5), 16, 10).cast("long") * chunks / (1 << 20)))
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy("skey", "chunk").agg(F.sum("size").alias("n")).select(
        "skey", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("skey", "chunk").orderBy("h", "doc_id", "size", "th")
    start = F.col("base") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = bases.join(plan.select("skey", "source_size", "target"), "skey")
    rows = sized.join(bases, ["skey", "chunk"]).withColumn("start", start).withColumn("row", F.row_number().over(within))
    return rows


def dealt(sized: DataFrame, block: int) -> DataFrame:
    """A row for each block of each document (block null: no words): what placed() gives, overlap, and times the block is taken."""
    plan = cut(targets(sized, block=block))
    picks = mixture(plan).groupBy("skey", "block").agg(F.count("*").alias("times"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = placed(sized, plan, block).withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last)))
    )
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    # both sides grow with the corpus
    return parts.withColumn("overlap", overlap).join(picks.hint("merge"), ["skey", "block"], "left")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return (
        dealt(cut(sizes(docs)), block)
        .groupBy("skey", "chunk", "row", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.col("overlap") * F.col("times")), F.lit(0)).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, with docs' columns: a row for each pass in which a document is taken, with the words that are.

    A text taken whole stays as it is; of others the words taken are joined by spaces. n_chars, where present, follows.
    """
    parts = dealt(cut(sizes(docs)), block).where("times > 0")
    which = ["doc_id", "th", "skey"]
    offset = F.greatest("start", F.col("block") * block) - F.col("start")
    taken = (
        parts.groupBy(*which, "chunk", "row", "size").agg(F.sort_array(F.collect_list(F.struct(offset.alias("at"), F.col("overlap").alias("n"), "times"))).alias("ranges"))
        .withColumn("copy", F.row_number().over(Window.partitionBy(*which).orderBy("chunk", "row")))
        .withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("ranges", lambda r: r["times"])))))
        .withColumn("ranges", F.filter("ranges", lambda r: r["times"] >= F.col("pass")))
    )
    whole = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["n"]) == F.col("size")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey")
    )
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*which).orderBy("th")))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in which] + [F.col("a.copy") == F.col("b.copy")]
    both = rows.alias("a").join(taken.select(*which, "copy", "ranges", whole.alias("whole")).alias("b"), keys[0] & keys[1] & keys[2] & keys[3])
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    spelt = both.select("row", "whole", "ranges", words.alias("words")).select(
        "row",
        F.when(F.col("whole"), F.col("row.text")).otherwise(
            F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice("words", (r["at"] + 1).cast("int"), r["n"].cast("int")))), " ")
        ).alias("text"),
    )
    out = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    return spelt.select(*(out[c].alias(c) if c in out else F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed by the standard weights."""
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    hexes = lambda text, digits=8: f"CAST(concat('0x', substr(md5({text}), 1, {digits})) AS BIGINT)"
    x = "SELECT skey, slot, blocks, slot % blocks AS x FROM slots"
    for r in range(ROUNDS):
        x = (
            f"SELECT skey, slot, blocks, CASE WHEN substr(md5(concat(skey, ':', k, ':', greatest(x, y))), 1, 1) >= '8' THEN y ELSE x END AS x "
            f"FROM (SELECT *, (k + blocks - x) % blocks AS y FROM (SELECT *, {hexes(f"concat(skey, ':', {r})")} AS k FROM ({x})))"
        )
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce('=' || source, '') AS skey, md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS h FROM documents),
per AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM per),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
plan AS (SELECT skey, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * (SELECT level FROM levels WHERE cap > weight * level ORDER BY cap / weight, skey LIMIT 1) END AS target,
    ceil(source_size / {BLOCK})::BIGINT AS blocks FROM levels),
ends AS (SELECT skey, blocks, n, sum(n) OVER (ORDER BY skey) AS end_ FROM (SELECT skey, blocks, least(round(target * blocks / source_size)::BIGINT, 2 * blocks) AS n FROM plan WHERE source_size > 0) WHERE n > 0),
total AS (SELECT sum(n)::BIGINT AS total FROM ends),
chances AS (SELECT i, total, (i - i // {SLOTS} * {SLOTS})::DOUBLE + {hexes(f"concat(i // {SLOTS}, '/', i)")}::DOUBLE / 4294967296.0::DOUBLE AS part, least({SLOTS}, total - i // {SLOTS} * {SLOTS})::DOUBLE AS size
  FROM (SELECT unnest(range((SELECT total FROM total))) AS i), total),
draws AS (SELECT i AS i, least(floor(part / size * total::DOUBLE)::BIGINT, total - 1) AS u FROM chances),
slots AS (SELECT skey, blocks, slot FROM (SELECT skey, blocks, row_number() OVER (PARTITION BY skey ORDER BY i) - 1 AS slot FROM draws JOIN ends ON u >= end_ - n AND u < end_) WHERE slot < 2 * blocks),
picks AS (SELECT skey, x AS block, count(*) AS times FROM ({x}) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY skey, h, doc_id, size) AS row,
    (sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM sized),
parts AS (SELECT row, skey, start, size, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
taken AS (SELECT row, sum((least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK})) * times) AS n FROM parts JOIN picks USING (skey, block) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(n, 0)::BIGINT AS taken FROM placed JOIN plan USING (skey) LEFT JOIN taken USING (row)"""


OP4_SQL = _oracle()
