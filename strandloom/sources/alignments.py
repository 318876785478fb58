"""Alignments from SAM text and BAM files."""

from __future__ import annotations

import binascii
import glob
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from strandloom.sources.files import open_file, write_file

SCHEMA = (
    "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, seq string, quals array<int>, tags map<string, string>"
)
COLUMNS = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "quals", "tags")
TYPES = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.map_(pa.string(), pa.string()))
FIELDS = [pa.field(n, t) for n, t in zip(COLUMNS, TYPES)]
# Codes, block header and last block of the format (fixed values of its specification).
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
MAGIC = b"\x1f\x8b\x08\x04"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bases as hexadecimal digits and back; what is no base is no digit either.
DIGITS = bytes(b"0123456789abcdef"[BASES.index(chr(x))] if chr(x) in BASES else 33 for x in range(256))
LETTERS = bytes.maketrans(b"0123456789abcdef", BASES.encode())
HEAD = struct.Struct("<iiBBHHHiiii")
#: Bytes of a file that a task reads; where parts are smaller, a task takes several rather than there being more tasks.
SPLIT, TASKS = 64 << 20, 1 << 10


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA, with the alignment's end (1-based, closed)."""
    from strandloom.functions import seq

    f = spark.read.text(path).filter("value <> '' AND NOT startswith(value, '@')").select(F.split("value", "\t").alias("f"))
    c = lambda k: F.col("f")[k]
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_replace(t, "^..:.:", "").alias("v"))))
    quals = F.when(c(10) != "*", F.transform(F.split(c(10), ""), lambda q: F.ascii(q) - 33))
    rows = f.select(
        c(0).alias("qname"), c(1).cast("int").alias("flag"), c(2).alias("chrom"), c(3).cast("long").alias("pos"), c(4).cast("int").alias("mapq"), c(5).alias("cigar"),
        F.when(c(6) == "=", c(2)).otherwise(c(6)).alias("mate_chrom"), c(7).cast("long").alias("mate_pos"), c(8).cast("long").alias("tlen"), c(9).alias("seq"), quals.alias("quals"), tags.alias("tags"),
    )
    return rows.withColumn("end", F.col("pos") + F.greatest(seq.reference_span(seq.cigar_units(F.col("cigar"))), F.lit(1)) - 1)


def sample_name(spark: SparkSession, path: str) -> DataFrame:
    """The one sample of a SAM header's read groups; several raise."""
    names = spark.read.text(path).filter(F.col("value").startswith("@RG")).select(F.regexp_extract("value", r"\tSM:([^\t]+)", 1).alias("sm")).distinct()
    one = names.agg(F.count("*").alias("n"), F.min("sm").alias("sm"))
    return one.select(F.when(F.col("n") == 1, F.col("sm")).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" samples in one file")))).alias("sm"))


def header_contigs(spark: SparkSession, path: str) -> DataFrame:
    g = lambda p: F.regexp_extract("value", p, 1)
    return spark.read.text(path).filter(F.col("value").startswith("@SQ")).select(g(r"\tSN:([^\t]+)").alias("chrom"), g(r"\tLN:(\d+)").cast("long").alias("length"))


def has_md(rows: DataFrame, peek: int = 1001) -> bool:
    """Does one of the first reads carry an MD tag?"""
    return bool(rows.limit(peek).agg(F.max(F.map_contains_key("tags", "MD"))).head()[0])


def tag(name: str, kind: str = "string") -> Column:
    """An optional field as string, bigint or double; null where it is missing or of another kind."""
    value = F.try_element_at("tags", F.lit(name))
    return value if kind == "string" else value.try_cast(kind)


def samples(files: DataFrame) -> DataFrame:
    """files(path, role, sm) with a dense index by role and name."""
    from pyspark.sql import Window as W

    return files.withColumn("idx", F.dense_rank().over(W.orderBy("role", "sm")) - 1)  # a small dimension


class _Blocks:
    """Decompressed blocks of a BGZF file, one after the other, from the first block at or behind a file offset."""

    def __init__(self, f, start: int):
        self.f, self.at = f, start
        f.seek(start)
        self.raw = b""
        if start:
            self._sync()

    def _fill(self, size: int) -> bool:
        while len(self.raw) < size and (more := self.f.read(1 << 18)):
            self.raw += more
        return len(self.raw) >= size

    def _size(self, at: int) -> int:
        """Size of the block at a place of raw; 0 if none begins there."""
        if not self._fill(at + 18) or self.raw[at : at + 4] != MAGIC or self.raw[at + 12 : at + 16] != b"BC\x02\x00":
            return 0
        return int.from_bytes(self.raw[at + 16 : at + 18], "little") + 1

    def _sync(self) -> None:
        """Go to the first block: it has a header, and another one follows it, or nothing does."""
        self._fill(2 * (1 << 16))
        at = self.raw.find(MAGIC)
        while at >= 0:
            size = self._size(at)
            if size and (not self._fill(at + size + 1) or self._size(at + size)):
                break
            at = self.raw.find(MAGIC, at + 1)
        at = len(self.raw) if at < 0 else at
        self.raw, self.at = self.raw[at:], self.at + at

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """File offset and data of each block that is not empty."""
        while size := self._size(0):
            if not self._fill(size):
                raise ValueError("a block is cut off")
            at, data = self.at, zlib.decompress(self.raw[18 : size - 8], -15)
            self.raw, self.at = self.raw[size:], self.at + size
            if data:
                yield at, data
        if self.raw:
            raise ValueError("no BGZF block")


class Bam:
    """Records of a part of a BAM file: those that begin in blocks from start to stop (file offsets)."""

    def __init__(self, path: str):
        self.f = open_file(path)
        stream = _Stream(_Blocks(self.f, 0))
        if stream.take(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        self.text = stream.take(stream.number()).decode()
        self.names, self.lengths = [], []
        for _ in range(stream.number()):
            self.names.append(stream.take(stream.number())[:-1].decode())
            self.lengths.append(stream.number())
        self.first = stream
        self.f.seek(0, 2)
        self.size = self.f.tell()
        self.f.seek(max(0, self.size - len(EOF)))
        if self.f.read() != EOF:
            raise ValueError(f"{path} does not end as a BAM file does")

    def records(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        stop = self.size if stop is None else stop
        if start:
            stream = _Stream(_Blocks(self.f, start))
            if not stream.to_record(self._plausible):
                return
        else:
            self.f.seek(self.first.blocks.at + len(self.first.blocks.raw))
            stream = self.first
        while (at := stream.place()) is not None and at < stop:
            yield stream.take(stream.number())

    def placed(self, begin: int, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
        """Virtual offsets of begin and end, and bytes, of the records from one virtual offset to another."""
        stream = _Stream(_Blocks(self.f, begin >> 16))
        stream.take(begin & 0xFFFF)
        at = stream.virtual()
        while at is not None and (end is None or at < end):
            record = stream.take(stream.number())
            after = stream.virtual()
            # At a block's end the next record begins in the next block.
            yield at, self.size << 16 if after is None else after, record
            at = after

    def header_end(self) -> int | None:
        """Virtual offset of the first record; None if there is none."""
        return self.first.virtual()

    def _plausible(self, b: bytes, at: int) -> int | None:
        """Size of the record that may begin there; None if it can't, 0 if b ends before that is known."""
        if at + 36 > len(b):
            return 0
        size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", b, at)
        n = len(self.names)
        if not (-1 <= ref < n and -1 <= mate < n and pos >= -1 and mate_pos >= -1 and n_name and n_seq >= 0 and (ref < 0 or pos < self.lengths[ref])):
            return None
        if size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
            return None
        name = b[at + 36 : at + 36 + n_name]
        if len(name) == n_name and (name[-1] or not all(33 <= x <= 126 for x in name[:-1])):
            return None
        return 4 + size


class _Stream:
    """Bytes of blocks, and the block that the next byte lies in."""

    def __init__(self, blocks: _Blocks):
        self.blocks, self.rest = blocks, iter(blocks)
        self.data, self.at, self.starts = b"", 0, []  # at: the next byte; starts: (place in data, file offset of the block)

    def _grow(self) -> bool:
        block = next(self.rest, None)
        if block is None:
            return False
        # What was taken goes now, so a block is copied once, whatever the size of its records.
        gone, self.at = self.at, 0
        starts = [(where - gone, at) for where, at in self.starts]
        self.starts = [x for x, after in zip(starts, [*starts[1:], (len(self.data) - gone, 0)]) if after[0] > 0]
        self.data = self.data[gone:]
        self.starts.append((len(self.data), block[0]))
        self.data += block[1]
        return True

    def place(self) -> int | None:
        """File offset of the block of the next byte; None at the end."""
        found = self.virtual()
        return None if found is None else found >> 16

    def virtual(self) -> int | None:
        """Virtual offset of the next byte: the block's file offset in 48 bits, the byte in it in 16; None at the end."""
        if self.at == len(self.data) and not self._grow():
            return None
        where, at = next(x for x in reversed(self.starts) if x[0] <= self.at)
        return at << 16 | self.at - where

    def take(self, size: int) -> bytes:
        while len(self.data) - self.at < size:
            if not self._grow():
                raise ValueError("the file ends within a record")
        self.at += size
        return self.data[self.at - size : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def to_record(self, plausible, chain: int = 5) -> bool:
        """Go to the first byte from which plausible records follow one another. Nothing has been taken yet."""
        first = 0
        while True:
            here, known = first, 0
            while known < chain:
                size = plausible(self.data, here)
                if size is None:
                    break
                if not size or here + size > len(self.data):
                    if self._grow():
                        continue
                    known = chain if size == 0 and here == len(self.data) and known else known
                    break
                here, known = here + size, known + 1
            if known == chain or known and here == len(self.data):
                self.take(first)
                return True
            first += 1
            if first >= len(self.data) and not self._grow():
                return False


def read_bam(
    path: str, start: int = 0, stop: int | None = None, columns: tuple[str, ...] = COLUMNS, regions: list[tuple] | None = None, least_mapq: int = 0, without_flags: int = 0, ranges: list[tuple[int, int]] | None = None
) -> Iterator[tuple]:
    """Columns of the records of a part of a BAM file that pass: mapping quality, no such flag, and overlap with one of
    the regions (chrom, start1, end1). Nothing else of a record that fails is decoded, nor other columns. The part goes from
    start to stop (file offsets), or is the ranges of virtual offsets that an index gives."""
    bam = Bam(path)
    spans: dict[int, list[tuple[int, int]]] = {}
    for chrom, a, b in regions or []:
        if chrom in bam.names:
            spans.setdefault(bam.names.index(chrom), []).append((a - 1, b))
    last = max(((r, max(b for _, b in s)) for r, s in spans.items()), default=None)
    ordered = "SO:coordinate" in bam.text.split("\n", 1)[0]
    every = bam.records(start, stop) if ranges is None else (b for x in ranges for _, _, b in bam.placed(*x))
    for b in every:
        ref, pos, n_name, mapq, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", b)
        if mapq < least_mapq or flag & without_flags:
            continue
        if regions is not None:
            if ordered and (last is None or ref > last[0] or (ref, pos) >= last or ref < 0):
                return
            if ref not in spans:
                continue
            end = _record_end(b)
            if not any(pos < y and end > x for x, y in spans[ref]):
                continue
        yield _record(b, bam.names, columns)


def _record_end(b: bytes) -> int:
    """Place behind the last base of the reference that a record covers, one base at least."""
    pos, n_name, n_cigar = struct.unpack_from("<iB3xH", b, 4)
    units = struct.unpack_from(f"<{n_cigar}I", b, 32 + n_name)
    return pos + max(1, sum(u >> 4 for u in units if u & 15 in (0, 2, 3, 7, 8)))


def _record(b: bytes, names: list[str], columns: tuple[str, ...]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = HEAD.unpack_from(b)
    cigar_at = 32 + n_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + (n_seq + 1) // 2
    of = lambda i: names[i] if i >= 0 else "*"

    def get(column: str):
        match column:
            case "qname":
                return b[32 : cigar_at - 1].decode()
            case "cigar":
                return _cigar(b[cigar_at:seq_at])
            case "seq":
                return binascii.hexlify(b[seq_at:qual_at]).translate(LETTERS).decode()[:n_seq]
            case "quals":
                return None if n_seq and b[qual_at] == 255 else list(b[qual_at : qual_at + n_seq])
            case "tags":
                return dict(_tags(b[qual_at + n_seq :]))
        return {"flag": flag, "chrom": of(ref), "pos": pos + 1, "mapq": mapq, "mate_chrom": of(mate), "mate_pos": mate_pos + 1, "tlen": tlen}[column]

    if columns == COLUMNS:
        return get("qname"), flag, of(ref), pos + 1, mapq, get("cigar"), of(mate), mate_pos + 1, tlen, get("seq"), get("quals"), get("tags")
    return tuple(map(get, columns))


@lru_cache(1 << 14)
def _cigar(packed: bytes) -> str:
    return "".join(f"{u >> 4}{OPS[u & 15]}" for u in struct.unpack(f"<{len(packed) // 4}I", packed)) or "*"


@lru_cache(1 << 14)
def _packed_cigar(cigar: str) -> bytes:
    units = [(int(n) << 4) | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return struct.pack(f"<{len(units)}I", *units)


def _tags(b: bytes) -> Iterator[tuple[str, str]]:
    number = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    at = 0
    while at < len(b):
        key, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(b[at]), at + 1
        elif kind in "ZH":
            end = b.index(0, at)
            value, at = b[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = number[chr(b[at])], struct.unpack_from("<i", b, at + 1)[0]
            values = struct.unpack_from(f"<{n}{sub}", b, at + 5)
            value, at = ",".join(map(str, values)), at + 5 + n * struct.calcsize(sub)
        else:
            value, at = str(struct.unpack_from("<" + number[kind], b, at)[0]), at + struct.calcsize(number[kind])
        yield key, value


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and size of the files of a pattern, in any store that Spark reads; raises before a job starts if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(conf).globStatus(pattern)
    if not found:
        raise FileNotFoundError(path)
    return [(str(x.getPath().toString()), x.getLen()) for x in found]


def bam(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS, regions: list[tuple] | None = None, least_mapq: int = 0, without_flags: int = 0, split: int = SPLIT, indexed: bool = False) -> DataFrame:
    """Columns of BAM files (path may be a pattern): a task reads split bytes of a file in Arrow batches, and decodes the
    wanted columns of the wanted records only. With indexed, each file has an index beside it (bamindex.write_indexes) and
    only what the index gives for the regions is opened."""
    fields = [f for f in FIELDS if f.name in columns]
    columns = tuple(f.name for f in fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                part = {"ranges": [(start, stop)]} if indexed else {"start": start, "stop": stop}
                yield from _batches(read_bam(file, columns=columns, regions=regions, least_mapq=least_mapq, without_flags=without_flags, **part), fields)

    if indexed:
        from strandloom.sources import bamindex

        rows = bamindex.planned(spark, [f for f, _ in files(spark, path)], regions or [], split)
    else:
        parts = [(f, at, at + split) for f, size in files(spark, path) for at in range(0, max(1, size), split)]
        tasks = min(len(parts), max(TASKS, len(parts) * split // SPLIT))
        rows = spark.createDataFrame(parts, "file string, start long, stop long").repartitionByRange(max(1, tasks), "file", "start")
    schema = ", ".join(x for x in SCHEMA.split(", ") if x.split(" ")[0] in columns or x.startswith("string>") and "tags" in columns)
    return rows.mapInArrow(read, schema)


def _batches(rows: Iterator[tuple], fields: list[pa.Field], size: int = 8192) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([_column(x, f) for x, f in zip(zip(*chunk), fields)], names=[f.name for f in fields])


def _column(values: tuple, field: pa.Field) -> pa.Array:
    """An Arrow column; lists and maps are made of flat arrays, not value by value."""
    if field.name not in ("quals", "tags"):
        return pa.array(values, field.type)
    offsets = pa.array([0, *accumulate(len(x or ()) for x in values)], pa.int32())
    if field.name == "tags":
        keys, items = (pa.array([y for x in values for y in of(x)], pa.string()) for of in (dict.keys, dict.values))
        return pa.MapArray.from_arrays(offsets, keys, items)
    flat = np.frombuffer(b"".join(bytes(x) for x in values if x), np.uint8).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([x is None for x in values]))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of SCHEMA; qualities as bytes and tags as pairs, taken from flat arrays."""

    def values(name: str) -> Iterable:
        column = batch.column(name)
        if name not in ("quals", "tags"):
            return column.to_pylist()
        ends = column.offsets.to_pylist()
        if name == "tags":
            pairs = list(zip(column.keys.to_pylist(), column.items.to_pylist()))
            return (pairs[a:b] if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist()))
        least, most = pc.min_max(column.values).as_py().values()
        if column.values.null_count or least is not None and not 0 <= least <= most <= 255:
            raise ValueError("a quality is null or no byte")
        flat = column.values.to_numpy().astype(np.uint8).tobytes()
        return (flat[a:b] if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist()))

    return zip(*map(values, COLUMNS))


class BamDataSource(DataSource):
    """spark.read.format("bam").load(path): a task a part of a file; path may be a local pattern or a file of another
    store. With option("pushdown", "true"), which needs spark.sql.python.filterPushdown.enabled, filters on mapping quality
    and chromosome are applied before a record is decoded."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringBamReader if self.options.get("pushdown") == "true" else BamReader)(self.options["path"])


@dataclass
class BamPart(InputPartition):
    path: str
    start: int
    stop: int


class BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.least_mapq, self.chroms = path, 0, None

    def partitions(self) -> list[InputPartition]:
        local = self.path.removeprefix("file://")
        paths = sorted(glob.glob(local)) or [self.path]
        out = []
        for p in paths:
            with open_file(p) as f:
                f.seek(0, 2)
                out += [BamPart(p, at, at + SPLIT) for at in range(0, max(1, f.tell()), SPLIT)]
        return out

    def read(self, partition: BamPart) -> Iterator[pa.RecordBatch]:
        regions = [(c, 1, 1 << 31) for c in self.chroms] if self.chroms and "*" not in self.chroms else None
        rows = read_bam(partition.path, partition.start, partition.stop, COLUMNS, regions, self.least_mapq)
        yield from _batches((r for r in rows if not self.chroms or r[2] in self.chroms), FIELDS)


class FilteringBamReader(BamReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case GreaterThanOrEqual(("mapq",), int(value)):
                    self.least_mapq = max(self.least_mapq, value)
                case GreaterThan(("mapq",), int(value)):
                    self.least_mapq = max(self.least_mapq, value + 1)
                case EqualTo(("chrom",), str(value)):
                    self.chroms = [value]
                case _:
                    yield f


def write_bams(rows: DataFrame, folder: str, contigs: list[tuple[str, int]], header: str = "") -> DataFrame:
    """Write alignments (columns of SCHEMA), in the order that they have in their tasks, as one BAM file a task: path, n.

    A file is made block by block and takes its name when it is whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in _rows(b))
        first, count = next(each, None), 0
        if first is None:
            return
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.bam"

        def counted() -> Iterator[tuple]:
            nonlocal count
            for r in chain([first], each):
                count += 1
                yield r

        write_file(path, bam_bytes(contigs, counted(), header))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "n"])

    return rows.select(*COLUMNS).mapInArrow(write, "path string, n long")


def write_bam(path: str, contigs: list[tuple[str, int]], rows: list[tuple], header: str = "", block: int = 60_000) -> None:
    """A small BAM file of rows of SCHEMA, for tests and exports of a window's reads."""
    write_file(path, bam_bytes(contigs, rows, header, block))


def bam_bytes(contigs: list[tuple[str, int]], rows: Iterable[tuple], header: str = "", block: int = 60_000) -> Iterator[bytes]:
    """Blocks of a BAM file."""
    data, number = bytearray(), {n: i for i, (n, _) in enumerate(contigs)}
    for x in chain([_bam_header(contigs, header)], (_bam_record(r, number) for r in rows)):
        data += x
        while len(data) >= block:
            yield _bgzf(bytes(data[:block]))
            del data[:block]
    if data:
        yield _bgzf(bytes(data))
    yield EOF


def _bgzf(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return MAGIC + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bam_header(contigs: list[tuple[str, int]], header: str) -> bytes:
    named = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in contigs)
    return b"BAM\1" + struct.pack("<i", len(header.encode())) + header.encode() + struct.pack("<i", len(contigs)) + named


def _bam_record(row: tuple, number: dict[str, int]) -> bytes:
    name, flag, chrom, pos, mapq, cigar, mate, mate_pos, tlen, seq, quals, tags = row
    units = _packed_cigar(cigar)
    body = HEAD.pack(number.get(chrom, -1), pos - 1, len(name) + 1, mapq, 0, len(units) // 4, flag, len(seq), number.get(mate, -1), mate_pos - 1, tlen)
    body += name.encode() + b"\0" + units + binascii.unhexlify((seq + "=" * (len(seq) % 2)).encode().translate(DIGITS))
    body += bytes(quals) if quals is not None else b"\xff" * len(seq)
    body += b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in dict(tags or {}).items())
    return struct.pack("<i", len(body)) + body
