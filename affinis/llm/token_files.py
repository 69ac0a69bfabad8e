"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code, with the control bytes kept apart.

A corpus is one Parquet folder with a row per document, shard by shard in ascending document id:
  shard int, at long (ids of the shard before this document), doc_id, n_tokens int, control binary, data binary.
Every id is replaced with its frequency rank (0: most frequent; ties to the smaller id). A rank takes 1 to 4 bytes, little
end first, in data; control has 2 bits a rank (bytes minus one), four ranks a byte, first rank in the lowest bits. The table
of ids by rank has one entry for each id of the vocabulary at most and lies beside it in a Parquet folder of its own.

Null texts count as empty; every document gets the end id. Equal doc_ids keep one row each, in order of a hash of their ids.
No documents give an empty folder.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut, partitions, removed, shared_dir, slices, small_batches, table, written
from affinis.llm.tokens import default_path, encoder

LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int8) + 1  # bytes of the four ranks of a control byte
PORTION = 2 << 20  # bytes of ids or codes handled at a time; a longer document is one portion


def portions(batches, column: int, most: int = PORTION):
    """The same Arrow rows in batches with about `most` bytes in the binary column given, one row at least."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def joined(column) -> np.ndarray:
    """All bytes of a binary column, row after row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)


def parted(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose rows end at `ends` in values."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def used(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of so many ranks, one after another: which of the 2-bit lengths in the control bytes are of ranks, not
    padding, and where each document's control bytes end."""
    ends = np.cumsum(-(-lengths // 4))
    mask = np.ones(4 * ends[-1] if len(ends) else 0, dtype=bool)
    for k in range(1, 4):
        mask[4 * ends[-lengths % 4 >= k] - k] = False
    return mask, ends


def encode_all(ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control, data, control ends, data ends) of documents with so many ranks each, one after another; ranks are below 2**32."""
    ranks = np.ascontiguousarray(ranks, dtype=np.uint32)
    size = np.ones(len(ranks), dtype=np.int8)
    for bits in (8, 16, 24):
        size += ranks >= (1 << bits)
    mask, control_ends = used(lengths)
    codes = np.zeros(len(mask), dtype=np.uint8)
    codes[mask] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.append(0, np.cumsum(size, dtype=np.int64))
    data = np.empty(ends[-1], dtype=np.uint8)
    data[ends[:-1]] = ranks & np.uint32(255)
    for k in (1, 2, 3):
        some = np.flatnonzero(size > k)
        if not len(some):
            break
        data[ends[some] + k] = ranks[some] >> np.uint32(8 * k) & np.uint32(255)
    return control, data, control_ends, ends[np.cumsum(lengths)]


def decode_all(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All ranks of documents with so many ranks each; byte lengths come from a table looked up by control byte."""
    size = LENGTHS[control].reshape(-1)[used(lengths)[0]]
    at = np.cumsum(size, dtype=np.int64) - size
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of one document's ranks."""
    control, data, _, _ = encode_all(ranks, np.array([len(ranks)]))
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """One document's n ranks."""
    return decode_all(np.frombuffer(control, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8), np.array([n]))


def tokenize(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids binary, counts null): the ids of whole texts, two bytes each where the vocabulary allows, with end_id after
    them; and from each partition a row (null, null, counts): how often it has each id from 0 on, eight bytes each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        end = np.array([] if end_id is None else [end_id], dtype=e.dtype).tobytes()
        names, total, empty = ["doc_id", "ids", "counts"], np.zeros(len(e.as_bytes), dtype=np.int64), None
        for b in slices(batches):
            ids = [e.encode(t).tobytes() + end for t in b.column(1).to_pylist()]
            for at in range(0, len(ids), 32):
                total += np.bincount(np.frombuffer(b"".join(ids[at : at + 32]), dtype=e.dtype), minlength=len(total))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
            empty = pa.nulls(1, b.column(0).type)
        if empty is not None:
            yield pa.RecordBatch.from_arrays([empty, pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, counts binary")


def frequencies(tokenized: DataFrame) -> DataFrame:
    """(id, n): how often each id stands in the whole of tokenized, from the partitions' counts."""

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                total = np.frombuffer(raw, dtype=np.int64)
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return tokenized.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Tokenize whole texts and write them under out (folders tokens and ranks), ascending by doc_id."""
    spark, path = docs.sparkSession, tokenizer or default_path()
    width = encoder(path).dtype.itemsize
    tokenized, kept = written(tokenize(docs, path, end_id), "token-ids")
    tokens = tokenized.where("counts IS NULL").select("doc_id", "ids")
    ranked = frequencies(tokenized).orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
    by_rank = np.array([r.id for r in ranked], dtype=np.uint32)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank int, id long").coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(batches):
        from pyspark import TaskContext

        shard, at = TaskContext.get().partitionId(), 0
        for b in portions(batches, 1):
            n = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // width
            control, data, control_ends, data_ends = encode_all(rank_of[joined(b.column(1)).view(f"<u{width}")], n)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), shard), pa.int32()), pa.array(starts, pa.int64()), b.column(0), pa.array(n, pa.int32()),
                    parted(control_ends, control), parted(data_ends, data),
                ],
                names=["shard", "at", "doc_id", "n_tokens", "control", "data"],
            )

    # ids are sorted before they are coded: cutting the ranges takes a pass over its input, which must stay a plain scan
    tie = F.xxhash64("ids")
    coded = (
        tokens.repartitionByRange(partitions(spark), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
        .mapInArrow(code, f"shard int, at long, doc_id {kind}, n_tokens int, control binary, data binary")
    )
    with small_batches(spark):
        coded.write.option("compression", "zstd").parquet(f"{out}/tokens")
    removed(spark, kept)


def read_tokens(spark, out: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, and ids array or ids_crc32) of a written corpus; start counts the ids of all documents before."""
    by_rank = np.zeros(0, dtype="<u4")
    if rows := spark.read.schema("rank int, id long").parquet(f"{out}/ranks").orderBy("rank").collect():
        by_rank = np.array([r.id for r in rows], dtype="<u4")
    rows = spark.read.parquet(f"{out}/tokens")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        for b in portions(batches, 5):
            n = b.column(3).to_numpy().astype(np.int64)
            ids = by_rank[decode_all(joined(b.column(4)), joined(b.column(5)), n)]
            ends = np.append(0, np.cumsum(n))
            if digest:
                raw = memoryview(ids).cast("B") if len(ids) else b""
                last = pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends.tolist(), ends[1:].tolist())], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], last], names=["shard", "at", "doc_id", "n_tokens", "last"])

    decoded = rows.select("shard", "at", "doc_id", "n_tokens", "control", "data").mapInArrow(
        decode, f"shard int, at long, doc_id {kind}, n_tokens int, last {'long' if digest else 'array<long>'}"
    )
    # one row for each shard
    sums = sorted(rows.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long"))).collect())
    before = np.cumsum([0, *(n for _, n in sums)])
    bases = spark.createDataFrame([(s, int(n)) for (s, _), n in zip(sums, before, strict=False)], "shard int, base long")
    return decoded.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("last").alias("ids_crc32" if digest else "ids"),
    )


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document through the files and back, as digests; the files go when these are taken."""
    out = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), out)
    digests = cut(read_tokens(spark, out, digest=True))
    removed(spark, out)
    return digests
