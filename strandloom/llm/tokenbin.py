r"""Token-id files: frequency-ranked ids in byte-aligned variable-length codes, control bytes apart.

Ids are replaced by their rank of frequency over the whole corpus, so that common ids take one byte.
A rank takes one to four bytes; two control bits hold its length less one, four ranks to a control
byte, and the control bytes of a block stand before its data bytes.

A file, little-endian: ``SLTOKID1``, u32 number of ranked ids, the ids by rank (u32 each), then blocks:
u32 entries, u32 ids, u32 data bytes; entries (i64 doc_id, u32 ids of it in this block, u8 flags:
1 first piece of its document, 2 last piece, 4 doc_id is null); control bytes; data bytes. A block
holds at most BLOCK ids; a longer document goes on in the next block, so memory is bounded whatever a
document's length.

Defined cases: a null text is empty (the end id only); null doc_ids come first; rows with equal doc_ids
stand one after the other, ordered by a hash of their ids; an empty table gives no file and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.common import remove, shared_dir, stored
from strandloom.llm.tokens import id_dtype, token_table, vocabulary_size

MAGIC = b"SLTOKID1"
BLOCK = 1 << 20
#: Ids to a file.
FILE_IDS = 1 << 23
#: Lengths of the four codes that a control byte tells.
LENGTHS = 1 + ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8)
ENTRY = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("flags", "u1")])


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks back: code lengths by table lookup, then a gather for each byte of the codes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in range(1, 4):
        longer = lengths > k
        if longer.any():
            ranks[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _joined(column: pa.BinaryArray, dtype: str) -> np.ndarray:
    """The ids of all rows of a column, one after the other, without a copy."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype) if data is not None else np.zeros(0, dtype)


def rank_table(tokens: DataFrame, vocabulary: int, dtype: str) -> np.ndarray:
    """All ids that occur, the most frequent first, ties by id: at most one entry an id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_joined(b.column("ids"), dtype), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype="<u4")


def write_files(tokens: DataFrame, ranked: np.ndarray, dtype: str, files: int, folder: str) -> DataFrame:
    """Write the ids in ascending doc_id order; one row a file: file_no, path, n_ids."""
    by_id = np.zeros(int(ranked.max(initial=0)) + 1, dtype="<u4")
    by_id[ranked] = np.arange(len(ranked), dtype="<u4")
    head = MAGIC + np.uint32(len(ranked)).tobytes() + ranked.tobytes()
    key = F.xxhash64("ids").alias("tie")
    ordered = tokens.select("doc_id", "ids", key).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def blocks(batches: Iterator[pa.RecordBatch], total: list[int]) -> Iterator[bytes]:
        entries: list[tuple] = []
        parts: list[np.ndarray] = []
        room = BLOCK

        def block() -> bytes:
            control, data = encode_ranks(np.concatenate(parts))
            n = sum(map(len, parts))
            return np.array([len(entries), n, len(data)], "<u4").tobytes() + np.array(entries, ENTRY).tobytes() + control + data

        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                ids = np.frombuffer(x.as_buffer(), dtype)
                total[0] += len(ids)
                for at in _cuts(len(ids), room):
                    piece = ids[at[0] : at[1]]
                    flags = (at[0] == 0) + 2 * (at[1] == len(ids)) + 4 * (doc_id is None)
                    entries.append((doc_id or 0, len(piece), flags))
                    parts.append(by_id[piece])
                    room -= len(piece)
                    if room <= 0:
                        yield block()
                        entries.clear()
                        parts.clear()
                        room = BLOCK
        if entries:
            yield block()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        number, total = TaskContext.get().partitionId(), [0]

        def chunks():
            yield head
            yield from blocks(_chain(first, batches), total)

        path = f"{folder}/ids-{number:06d}.sltok"
        store.write_file(path, chunks())
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([total[0]], pa.int64())], names=["file_no", "path", "n_ids"])

    return ordered.select("doc_id", "ids").mapInArrow(write, "file_no int, path string, n_ids long")


def _chain(first, rest):
    yield first
    yield from rest


def _cuts(n: int, room: int) -> list[tuple[int, int]]:
    """Pieces of n ids: the first fills the block that has room, the others whole blocks."""
    ends = [*range(min(room, n), n, BLOCK), n]
    return list(zip([0, *ends[:-1]], ends))


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Pieces of documents: doc_id, flags, ids."""
    with store.open_file(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        table = np.frombuffer(f.read(4 * int(np.frombuffer(f.read(4), "<u4")[0])), "<u4")
        while head := f.read(12):
            n_entries, n, n_data = map(int, np.frombuffer(head, "<u4"))
            entries = np.frombuffer(f.read(n_entries * ENTRY.itemsize), ENTRY)
            control = f.read(-(-n // 4))
            ids = table[decode_ranks(control, f.read(n_data), n)]
            ends = np.cumsum(entries["n"], dtype=np.int64)
            for doc_id, m, flags, end in zip(entries["doc_id"].tolist(), entries["n"].tolist(), entries["flags"].tolist(), ends.tolist()):
                yield None if flags & 4 else doc_id, flags, ids[end - m : end]


def read_files(manifest: DataFrame) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32; a task reads a file or so."""
    files = max(1, manifest.count())
    before = F.sum("n_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))
    placed = manifest.withColumn("base", F.coalesce(before, F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                rows: list[tuple] = []
                start = crc = 0
                for doc_id, flags, ids in read_file(path):
                    if flags & 1:
                        start, crc = at, 0
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                    at += len(ids)
                    if flags & 2:
                        rows.append((doc_id, start, at - start, crc))
                    if len(rows) >= 50_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return placed.repartitionByRange(files, "file_no").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=names)


def token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Encode docs, write the files below the shared folder; the manifest has one row a file."""
    spark = docs.sparkSession
    vocabulary = vocabulary_size(path)
    dtype = id_dtype(vocabulary)
    folder = shared_dir(spark, "token-ids")
    token_table(docs, path, end_id).select("doc_id", "ids").write.option("compression", "zstd").parquet(f"{folder}/tokens")
    tokens = spark.read.schema("doc_id long, ids binary").parquet(f"{folder}/tokens")
    total = tokens.select(F.sum(F.octet_length("ids"))).head()[0] or 0
    ranked = rank_table(tokens, vocabulary, dtype)
    files = max(1, -(-total // (FILE_IDS * np.dtype(dtype).itemsize)))
    files = max(files, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, total >> 20)))
    manifest = stored(write_files(tokens, ranked, dtype, files, f"{folder}/files"), "token-manifest")
    remove(spark, f"{folder}/tokens")
    return manifest
