"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant: a 64-bit string within r bits of both. Every distinct
fingerprint emits its variants within r = 2 bits, and equal variants meet. The 2,081 variants of a fingerprint are not sent
one by one: those with the same leading bits share one row, and the task that owns those leading bits spells out the rest. Where
many fingerprints crowd on the same leading bits, their rows go on by STEP more bits, time after time, up to all but eight: one
task then holds at most the fingerprints around a single prefix. All fingerprints that share a variant are within 2r bits of each other, so a variant's fingerprints are linked to one of them, in
a chain that stays linear however many there are; each link is checked. Classes of equal fingerprints come first, by an
aggregate that combines before its shuffle, and only one member stands for a class.

Null texts count as empty; empty texts have fingerprint zero and link like any other. Rows with equal ids keep one row each.
A null doc_id never names a component: a group in which every id is null has a null one.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import components, cut, slices, table

BITS, RADIUS, PER_BUCKET, PASS, HOT, STEP = 64, 2, 512, 1_000_000, 8, 8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of lower-cased (A-Z) text over XXH64 (seed 42) of its word shingles, repeats included, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs' doc_id and th (xxhash64 of the text) with fp, the fingerprint as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "th", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, fp long")


def flips(bits: int, most: int) -> np.ndarray:
    """Masks of all ways to flip at most so many of the lowest bits."""
    masks = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]
    return np.array(masks, dtype=np.uint64)


def chained(fps: np.ndarray, bucket: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index) that join all fps with a common variant whose leading bits are bucket."""
    tail = np.uint64(BITS - lead)
    off = np.bitwise_count((fps >> tail) ^ np.uint64(bucket)).astype(np.int64)
    rest = fps & np.uint64((1 << (BITS - lead)) - 1)
    masks = [flips(BITS - lead, RADIUS - k) for k in range(RADIUS + 1)]
    number = sum(int((off == k).sum()) * len(m) for k, m in enumerate(masks))
    passes = 1 << max(0, math.ceil(math.log2(max(1, number) / PASS)))
    label = np.arange(len(fps))
    for turn in range(passes):
        keys, owners = [], []
        for k, m in enumerate(masks):
            own = np.flatnonzero(off == k)
            for at in range(0, len(own), max(1, PASS // len(m))):
                some = own[at : at + max(1, PASS // len(m))]
                variants, who = (rest[some, None] ^ m).ravel(), np.repeat(some, len(m))
                if passes > 1:
                    mine = (variants * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == turn
                    variants, who = variants[mine], who[mine]
                keys.append(variants)
                owners.append(who)
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        same = np.flatnonzero(keys[1:] == keys[:-1])
        a, b = owners[same], owners[same + 1]
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= 2 * RADIUS).all()
        while len(a):  # smallest label over all links so far
            low = np.minimum(label[a], label[b])
            was = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != label[label]).any():
                label = label[label]
            if (label == was).all():
                break
    other = np.flatnonzero(label != np.arange(len(fps)))
    return other, label[other]


def links(distinct: DataFrame, count: int) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that connect whatever is within 2 * RADIUS bits, directly or in steps."""
    lead = min(24, max(4, math.ceil(math.log2(max(1, count) / PER_BUCKET))))

    def met(rows: DataFrame, lead: int) -> DataFrame:
        def meet(key, group):
            fps = group.column(1).to_numpy().view(np.uint64)
            a, b = chained(fps, key[0].as_py(), lead)
            return pa.table({"a": pa.array(fps[a].view(np.int64)), "b": pa.array(fps[b].view(np.int64))})

        return rows.select("bucket", "fp").groupBy("bucket").applyInArrow(meet, "a long, b long")

    def spread(rows: DataFrame, bucket, bits: int) -> DataFrame:
        """rows with bucket as given, but for up to `left` flips of its lowest bits."""
        masks = F.array(*(F.struct(F.lit(int(m)).alias("m"), F.lit(int(m).bit_count()).alias("k")) for m in flips(bits, RADIUS)))
        each = rows.select("fp", "left", bucket.alias("at"), F.explode(masks).alias("flip")).where("flip.k <= left")
        return each.select(F.col("at").bitwiseXOR(F.col("flip.m")).alias("bucket"), "fp", (F.col("left") - F.col("flip.k")).alias("left"))

    rows = spread(distinct.select("fp", F.lit(RADIUS).alias("left")), F.shiftrightunsigned("fp", BITS - lead), lead)
    done = []
    most = HOT * PER_BUCKET
    while lead + STEP < BITS:
        crowd = distinct.groupBy(F.shiftrightunsigned("fp", BITS - lead).alias("own")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if not crowd or crowd <= most:
            break
        # crowded leading bits: more of them part the variants of the fingerprints there
        crowded = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most * len(flips(lead, RADIUS))).select("bucket"))
        done.append(met(rows.join(crowded, "bucket", "left_anti"), lead))
        lead += STEP
        following = F.shiftrightunsigned("fp", BITS - lead).bitwiseAND(F.lit((1 << STEP) - 1))
        rows = spread(rows.join(crowded, "bucket", "left_semi"), F.shiftleft("bucket", STEP).bitwiseOR(following), STEP)
    return reduce(DataFrame.unionByName, [*done, met(rows, lead)])


def groups(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, th, fp, component_id) of every document, linked at 2 * RADIUS or fewer differing bits."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = cut(links(classes.select("fp"), classes.count()).distinct())
    found = components(joined)
    by_fp = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = by_fp.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(by_fp.join(least, "component").select("fp", "component", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the smallest id; nulls come last. Rows with that id and text
    count once, and which of them stays is open where their other columns differ. Columns may have any names."""
    grouped = cut(groups(docs))
    best = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("best"))
    keep = best.select(F.col("best.doc_id").alias("k_id"), F.col("best.th").alias("k_th"))
    rows = docs.select(F.col("doc_id").alias("r_id"), F.xxhash64("text").alias("r_th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(keep, rows["r_id"].eqNullSafe(keep["k_id"]) & (rows["r_th"] == keep["k_th"]), "left_semi")
    # a component's rows are those of one pair: rows that repeat it count once, whatever other components share the id
    return kept.dropDuplicates(["r_id", "r_th"]).select("row.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    return groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
