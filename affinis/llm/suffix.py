"""Removal of every byte that a repeated string of `window` bytes covers, by a depth-limited radix sort of suffixes.

Suffixes are told apart only through `window` bytes, in passes over digits, the most significant first, and a pass goes on with
those suffixes alone whose digits so far occur more than once; groups equal in all digits are the repeated windows.

Not each byte's suffix travels (at 12 bytes or more a row that alone would be twelve times the input), but one for each run of
neighbouring windows that share an anchor: the first of a window's 64-byte grams with the least hash. Equal windows have equal
anchors at equal places, so the suffixes at anchors stand for all others.
Digit 1: the leading 64 bytes of the suffix at the anchor. Suffixes are counted by it (an aggregate that combines before its
shuffle), and those whose digit is unique are done.
Digit 2: what else the run's windows hold, before and after it. Equal runs repeat in all their windows. What is left are runs
that share an anchor with different runs: one of each content stands for the rest.
Digit 3: each of those runs' windows, one by one. Anchors with up to GROUP contents meet in a task by contents; larger groups
are counted window by window, again by an aggregate that combines first.

Digit 1 is compared as a 64-bit hash, which only brings candidates together; digit 2 as a 128-bit BLAKE2 digest of the bytes;
digit 3 on the bytes themselves, in groups above GROUP as two 64-bit hashes. Texts are UTF-8 bytes; null is empty. Matches never
cross documents; overlapping ones count, and repeated rows are repeats of each other. Texts under `window` bytes stay. Columns of
the caller may have any names: they travel as one.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from affinis.llm.common import cut, numbered, partitions, released, slices, table

WINDOW, GRAM, GROUP = 200, 64, 5_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    x = (x ^ (x >> np.uint64(32))) * ODD[2]
    return x ^ (x >> np.uint64(29))


class Grams:
    """Hashes of all grams of a byte string whose sizes are sums of 8, 16, 32, ...: eight bytes are their own number, and the
    numbers of two halves are mixed, not added, into that of the whole."""

    def __init__(self, data: np.ndarray, most: int, seed: int = 0):
        self.seed = np.uint64(seed)
        self.by = {8: np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()}
        size = 8
        while 2 * size <= most:
            now = self.by[size]
            self.by[2 * size] = self.both(now[:-size], now[size:])
            size *= 2

    def both(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a ^ self.seed) * ODD[0]
        x ^= x >> np.uint64(31)
        x = (x + b) * ODD[1]
        x ^= x >> np.uint64(29)
        return x

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        """The hash of the size bytes from each start on; size is a multiple of 8."""
        out = np.zeros(len(start), dtype=np.uint64)
        bit = 1 << (size.bit_length() - 1)
        while size:
            if size >= bit:
                out = self.both(out, self.by[bit][start])
                start, size = start + bit, size - bit
            bit >>= 1
        return mixed(out)


def runs(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, anchor's place) of each run of windows with one anchor."""
    if len(data) < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    each = mixed(Grams(data, gram).by[gram])
    place = (each & HIGH) | np.arange(len(each), dtype=np.uint64)
    span, size = window - gram + 1, 1
    while 2 * size <= span:
        place = np.minimum(place[:-size], place[size:])
        size *= 2
    if span > size:
        place = np.minimum(place[: size - span], place[span - size :])
    anchor = (place & LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    at = anchor[first]
    return each[at], first, last, at


def digests(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2): 128-bit digests of the stretches of data."""
    digest = hashlib.blake2b
    raw = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def all_runs(base: DataFrame, window: int, contents: bool) -> DataFrame:
    """Every run of every text in base (row, z): (anchor[, c1, c2, row, first, shape]); c1 and c2 are the digest of its content,
    shape holds the number of windows and, from bit 16 on, how far the anchor is from the first window's start."""
    names = ["anchor", "c1", "c2", "row", "first", "shape"] if contents else ["anchor"]

    def run(batches):
        for b in slices(batches, 64):
            found, digest = [], []
            for z in b.column(1).to_pylist():
                data = unpacked(z)
                found.append(runs(np.frombuffer(data, dtype=np.uint8), window))
                if contents:
                    digest.append(digests(data, found[-1][1], found[-1][2] + window))
            if not found:
                continue
            a, first, last, at = (np.concatenate(x) for x in zip(*found, strict=True))
            cols = [pa.array(a.view(np.int64))]
            if contents:
                c = np.concatenate(digest)
                row = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                shape = ((last - first + 1) | (at - first) << 16).astype(np.int32)
                cols += [pa.array(c[:, 0]), pa.array(c[:, 1]), row, pa.array(first.astype(np.int32)), pa.array(shape)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = "anchor long" + ", c1 long, c2 long, row long, first int, shape int" * contents
    return base.select("row", "z").mapInArrow(run, kinds)


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def starts(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in all contents, content, window number) of each window of contents of these sizes, one after another."""
    base, n = np.cumsum(sizes) - sizes, sizes - window + 1
    owner = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return base[owner] + number, owner, number


def repeated(data: np.ndarray, at: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that start at `at` in data occur more than once there: found by key, compared on their bytes."""
    _, index, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(n[inverse] > 1)
    view = np.lib.stride_tricks.sliding_window_view(data, window)
    same = np.ones(len(hit), dtype=bool)
    for k in range(0, len(hit), 8192):
        some = hit[k : k + 8192]
        same[k : k + 8192] = (view[at[some]] == view[at[index[inverse[some]]]]).all(axis=1)
    if not same.all():  # a key of different strings: its windows by their bytes
        mixed_keys = np.isin(inverse[hit], inverse[hit][~same])
        own = [data[at[h] : at[h] + window].tobytes() for h in hit[mixed_keys]]
        count = Counter(own)
        good = np.ones(len(hit), dtype=bool)
        good[mixed_keys] = [count[x] > 1 for x in own]
        hit = hit[good]
    return hit


def shared_windows(reps: DataFrame, window: int) -> DataFrame:
    """(row, s): windows of the runs reps (anchor, row, first, before, bytes, members) that another of them has too."""
    counted = reps.withColumn("large", F.col("members") > GROUP)

    def groups(t: pa.Table):
        """Whole groups of t, sorted by anchor, so many at a time that their windows take little memory."""
        anchors = t.column("anchor").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])), len(anchors))
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + GROUP, side="right")) - 1)
            yield t.slice(int(edges[at]), int(edges[to] - edges[at]))
            at = to

    def found(t: pa.Table):
        for part in groups(t):
            contents = part.column("bytes").to_pylist()
            data = np.frombuffer(b"".join(contents), dtype=np.uint8)
            at, owner, number = starts(np.array(list(map(len, contents)), dtype=np.int64), window)
            anchors = part.column("anchor").to_numpy().view(np.uint64)[owner]
            offset = (part.column("before").to_numpy()[owner] - number).astype(np.uint64)
            key = mixed(Grams(data, window).at(at, window) + anchors * ODD[0] + offset * ODD[3])
            hit = repeated(data, at, key, window)
            who = pa.array(owner[hit])
            s = part.column("first").to_numpy()[owner[hit]] + number[hit]
            yield pa.RecordBatch.from_arrays([part.column("row").combine_chunks().take(who), pa.array(s.astype(np.int32))], names=["row", "s"])

    def within(batches):
        rest = None  # the last group, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
            anchors = t.column("anchor").to_numpy()
            cut_at = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if anchors[0] != anchors[-1] else 0
            if cut_at:
                yield from found(t.slice(0, cut_at))
            rest = t.slice(cut_at)
        if rest is not None:
            yield from found(rest)

    def spelt(batches):
        for b in slices(batches):
            if not b.num_rows:
                continue
            c = {k: b.column(b.schema.get_field_index(k)) for k in ("row", "first", "bytes")}
            contents = c["bytes"].to_pylist()
            data = np.frombuffer(b"".join(contents), dtype=np.uint8)
            at, owner, number = starts(np.array(list(map(len, contents)), dtype=np.int64), window)
            keys = [pa.array(Grams(data, window, seed).at(at, window).view(np.int64)) for seed in (1, 2)]
            who = pa.array(owner)
            s = c["first"].to_numpy()[owner] + number
            yield pa.RecordBatch.from_arrays([*keys, c["row"].take(who), pa.array(s.astype(np.int32))], names=["k1", "k2", "row", "s"])

    small = (
        counted.where("NOT large").select("anchor", "row", "first", "before", "bytes")
        .repartition(4 * partitions(reps.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(within, "row long, s int")
    )
    each = counted.where("large").mapInArrow(spelt, "k1 long, k2 long, row long, s int")
    twice = each.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    return small.unionByName(each.join(twice, ["k1", "k2"]).select("row", "s"))


def repeats(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, first, n): runs of windows that occur again; base has row, a number of each text's own, and z, its packed bytes."""
    if window % 8 or window < GRAM + 8:
        raise ValueError("a window is a multiple of 8 bytes and longer than an anchor")
    # written, so that the join below shuffles both sides on their own and a hot anchor's runs can be split
    twice = cut(all_runs(base, window, False).groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1").select("anchor"))
    marked = cut(all_runs(base, window, True).join(twice, "anchor"))
    released(base.sparkSession)
    content = ["anchor", "c1", "c2"]
    contents = cut(marked.groupBy(*content).agg(F.count("*").alias("times"), F.min(F.struct("row", "first", "shape")).alias("rep")))
    members = cut(contents.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1"))
    released(base.sparkSession)
    # every copy of a content that occurs twice
    whole = marked.join(contents.where("times > 1").select(*content), content).select("row", "first", F.col("shape").bitwiseAND(0xFFFF).alias("n"))
    reps = contents.select("anchor", "rep.*").join(members, "anchor")
    # as many at most as the text has runs
    by_text = reps.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "shape", "members")).alias("runs"))

    def cut_out(batches):
        for b in slices(batches, 64):
            own = b.column(2).flatten()
            anchor, first, shape, members = (own.field(k) for k in range(4))
            owner = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            start, shape = first.to_numpy().astype(np.int64), shape.to_numpy()
            end = start + (shape & 0xFFFF) + window - 1
            texts = [unpacked(z) for z in b.column(1).to_pylist()]
            part = [texts[t][i:j] for t, i, j in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [anchor, b.column(0).take(pa.array(owner)), first, pa.array((shape >> 16).astype(np.int32)), pa.array(part, pa.binary()), members],
                names=["anchor", "row", "first", "before", "bytes", "members"],
            )

    pieces = base.select("row", "z").join(by_text, "row").select("row", "z", "runs").mapInArrow(
        cut_out, "anchor long, row long, first int, before int, bytes binary, members long"
    )
    return whole.unionByName(shared_windows(pieces, window).select("row", F.col("s").alias("first"), F.lit(1).alias("n")))


def packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, z, caller) of docs, written: a number of each row's own, its text packed, and the columns named, as one."""
    caller = StructType([docs.schema[c] for c in columns])

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            z = [press.compress((t or "").encode()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.binary()), b.column(1)], names=["z", "caller"])

    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("caller"))
    return cut(numbered(rows.mapInArrow(run, StructType([StructField("z", BinaryType()), StructField("caller", caller)])), "row"))


def kept_parts(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """(caller, kept, n_bytes, n_removed, n_spans, kept_sha256) of every document: caller is a struct of doc_id, or with texts of all
    columns but the text, and kept is the text that is left (null without texts; the digest is null with them)."""
    base = packed(docs, [c for c in docs.columns if c != "text"] if texts else ["doc_id"])
    found = repeats(base, window)
    # as many at most as the text has windows
    spans = found.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("spans")).select("row", F.col("spans.first").alias("starts"), F.col("spans.n").alias("lengths"))

    def finish(batches):
        for b in slices(batches):
            out = []
            every_start, every_length = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2))
            to = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy())
            for z, at, end in zip(b.column(0).to_pylist(), np.append(0, to[:-1]).tolist(), to.tolist(), strict=True):
                data = unpacked(z)
                n, gone, pieces, kept = len(data), 0, 0, data
                if end > at:
                    first = every_start[at:end]
                    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + every_length[at:end] + window - 1, minlength=n + 1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone, pieces = int(cover.sum()), int((np.diff(cover.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~cover].tobytes()
                out.append((kept.decode(errors="ignore") if texts else None, n, gone, pieces, None if texts else hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(3), *made], names=["caller", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    fields = [StructField("kept", StringType()), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())]
    joined = base.join(spans, "row", "left").select("z", "starts", "lengths", "caller")
    return cut(joined.mapInArrow(finish, StructType([base.schema["caller"], *fields])))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated bytes taken out of the texts (a letter cut in two goes whole) and n_chars, where present, to match."""
    done = kept_parts(docs, window, texts=True)
    out = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast("long")} if "n_chars" in docs.columns else {})
    return done.select(*((out[c] if c in out else F.col("caller").getField(c)).alias(c) for c in docs.columns))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, less their repeated 200-byte strings."""
    return kept_parts(table(spark, sf_dir, "documents")).select("caller.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
