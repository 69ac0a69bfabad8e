"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous rounds.

Documents become pieces of at most `length` ids; of a longer one the first piece may be shorter. Pieces over half a sequence
open one each. The others come in bands of size, each a quarter of the one before, largest first. A band takes two rounds:

1. Its pieces and all gaps that may hold them are sorted by size, largest first, and dealt over tasks by ranges of that order;
   equal sizes may be dealt over several tasks. Each task sweeps its range: a piece's successor is the least gap that holds it,
   the pieces that want one gap get it in the order of their ranks, what is left of a gap is a gap again.
2. Pieces without a successor in their range, and the gaps that are left, are dealt over tasks by rank of a hash, and swept again
   there: gaps of larger ranges meet the pieces that are left. What fits nowhere opens a sequence, whose gap is open to the rest.

Then gaps are updated, and the next band follows: two rounds for each quartering of the length, whatever the input's size. A task
holds its share of the rows as numbers. Nothing comes to the driver but whether pieces are left.

Null texts count as empty; each document has at least its end id. Rows with equal ids are packed one by one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut, numbered, own_name, slices, table
from affinis.llm.tokens import default_path, encoder


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of whole texts with end_id after each."""
    path = tokenizer or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for b in slices(batches):
            rows, at = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(e.encode(text), e.dtype.type(end_id)).astype("<u4")
                start, n = 0, (len(ids) - 1) % length + 1
                while start < len(ids):
                    part = ids[start : start + n]
                    rows.append((start, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                    at.append(k)
                    start, n = start + n, length
            first = np.flatnonzero(np.diff(np.array([-1, *at])))
            number = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            cols = [
                b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array([r[3] for r in rows], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    )


def sweep(sizes: list[int], gaps: list[tuple[int, int]], fresh: list[int] | None, length: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Best fit of pieces of these sizes, in descending order, into gaps (gap, sequence): each piece's sequence (-1: none) and
    offset, and the gaps that are left. A piece that fits nowhere opens the sequence of its number in fresh, if that is given."""
    held: dict[int, list[int]] = {}
    order: list[int] = []  # the gaps there are, ascending

    def leave(gap: int, sequence: int) -> None:
        if gap not in held:
            held[gap] = []
            insort(order, gap)
        held[gap].append(sequence)

    for gap, sequence in gaps:
        leave(gap, sequence)
    where, offsets = [], []
    for n, size in enumerate(sizes):
        k = bisect_left(order, size)
        if k < len(order):
            gap = order[k]
            sequence = held[gap].pop()
            if not held[gap]:
                del held[gap], order[k]
        elif fresh is not None:
            gap, sequence = length, fresh[n]
        else:
            where.append(-1)
            offsets.append(0)
            continue
        where.append(sequence)
        offsets.append(length - gap)
        if gap > size:
            leave(gap - size, sequence)
    return where, offsets, [(gap, s) for gap in order for s in held[gap]]


STATE = "kind int, id long, size int, sequence_id long, offset long"  # kinds: 0 a gap, 1 a piece without a place, 2 a placed piece


def swept(items: DataFrame, length: int, opens: bool) -> DataFrame:
    """The STATE of items (kind, id, size), whose partitions are sorted by size, largest first, after a sweep of each partition."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables).combine_chunks()
        kind, own, size = (t.column(c).to_numpy() for c in ("kind", "id", "size"))
        piece = kind == 1
        ids, sizes = own[piece], size[piece]
        where, offsets, left = sweep(sizes.tolist(), list(zip(size[~piece].tolist(), own[~piece].tolist(), strict=True)), ids.tolist() if opens else None, length)
        where = np.array(where, dtype=np.int64)
        gaps = np.array(left, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(gaps)), np.where(where < 0, 1, 2)]).astype(np.int32)), pa.array(np.concatenate([gaps[:, 1], ids])),
                pa.array(np.concatenate([gaps[:, 0], sizes]).astype(np.int32)), pa.array(np.concatenate([gaps[:, 1], where])),
                pa.array(np.concatenate([length - gaps[:, 0], np.array(offsets, dtype=np.int64)])),
            ],
            names=["kind", "id", "size", "sequence_id", "offset"],
        )

    return items.select("kind", "id", "size").mapInArrow(run, STATE)


def places(sized: DataFrame, length: int) -> DataFrame:
    """(id, sequence_id, offset) of every piece (id, size); a sequence has the id of the piece that opened it."""
    piece, gap, tie = F.lit(1).alias("kind"), F.lit(0).alias("kind"), F.xxhash64("id", "kind")
    half = length // 2
    done = [sized.where(F.col("size") > half).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    small = sized.where(F.col("size") <= half).select(piece, "id", "size")
    # gaps of all sizes; those too small for a band wait for the next
    gaps = sized.where((F.col("size") > half) & (F.col("size") < length)).select(gap, "id", (F.lit(length) - F.col("size")).cast("int").alias("size"))
    high = half
    while high >= 1:
        low = high // 4
        band = small.where((F.col("size") > low) & (F.col("size") <= high))
        items = band.unionByName(gaps.where(F.col("size") > low))
        by = [F.desc("size"), F.asc("kind"), tie]
        first = cut(swept(items.repartitionByRange(*by).sortWithinPartitions(*by), length, False))
        done.append(first.where("kind = 2").select("id", "sequence_id", "offset"))
        waiting = [gaps.where(F.col("size") <= low), first.where((F.col("kind") == 0) & (F.col("size") <= low)).select("kind", "id", "size")]
        still = first.where((F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("size") > low)))
        if not first.where("kind = 1").isEmpty():
            second = cut(swept(still.select("kind", "id", "size").repartition(tie).sortWithinPartitions(*by), length, True))
            done.append(second.where("kind = 2").select("id", "sequence_id", "offset"))
            still = second.where("kind = 0")
        gaps = reduce(DataFrame.unionByName, [*waiting, still.select("kind", "id", "size")])
        high = low
    return reduce(DataFrame.unionByName, done)


def pack(parts: DataFrame, length: int = 1024) -> DataFrame:
    """parts (length, ...) with sequence_id and offset: as few sequences of `length` as best-fit finds. Columns of parts with these
    two names give way. Raises for a piece that is longer than a sequence or empty."""
    cols = [c for c in parts.columns if c.lower() not in ("sequence_id", "offset")]
    own = own_name("piece_number", cols)
    dealt = cut(numbered(parts.select(*(F.col(f"`{c}`") for c in cols)), own))
    size = F.when(F.col("length").between(1, length), F.col("length")).otherwise(F.raise_error(F.lit("a piece does not fit a sequence")))
    placed = places(dealt.select(F.col(own).alias("id"), size.cast("int").alias("size")), length)
    return dealt.join(placed, dealt[own] == placed["id"]).select(*(F.col(f"`{c}`") for c in cols), "sequence_id", "offset")


def op7_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 1024."""
    return pack(pieces(table(spark, sf_dir, "documents")))
