"""Binning and linear index of a sorted BAM file, in the format's own form (.bai): written by tasks, and read to plan which
parts of a file a region needs."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources import alignments
from strandloom.sources.files import open_file, write_file

# Bits of the bins' widths and number of the first bin, level by level from the finest (fixed values of the format).
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
TILE = 14


def bin_of(begin: int, end: int) -> int:
    """The finest bin that holds [begin, end)."""
    return next((first + (begin >> s) for s, first in LEVELS if begin >> s == end - 1 >> s), 0)


def bins_over(begin: int, end: int) -> Iterator[int]:
    """Bins that overlap [begin, end)."""
    yield 0
    for s, first in LEVELS:
        yield from range(first + (begin >> s), first + (end - 1 >> s) + 1)


class Index:
    """By reference: chunks of virtual offsets by bin, and by tile of 16 kb the least offset of a record that reaches it."""

    def __init__(self, references: int):
        self.bins: list[dict[int, list[list[int]]]] = [defaultdict(list) for _ in range(references)]
        self.tiles: list[list[int]] = [[] for _ in range(references)]

    def add(self, ref: int, begin: int, end: int, start: int, stop: int) -> None:
        chunks, tiles = self.bins[ref][bin_of(begin, end)], self.tiles[ref]
        if chunks and chunks[-1][1] == start:
            chunks[-1][1] = stop
        else:
            chunks.append([start, stop])
        last = end - 1 >> TILE
        tiles += [0] * (last + 1 - len(tiles))
        for t in range(begin >> TILE, last + 1):
            tiles[t] = tiles[t] or start

    def ranges(self, ref: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Virtual offsets that hold every record that overlaps [begin, end)."""
        tiles = self.tiles[ref]
        if begin >> TILE >= len(tiles):
            return []  # no record reaches so far
        # Tiles that no record reaches have no offset: then that of the next one with one counts.
        least = next((t for t in tiles[begin >> TILE :] if t), 0)
        own = self.bins[ref]
        wanted = (own[b] for b in bins_over(begin, end) if b in own) if end - begin < 1 << 29 else own.values()
        return [(max(a, least), b) for chunks in wanted for a, b in chunks if b > least]

    def to_bytes(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, tiles in zip(self.bins, self.tiles):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack(f"<i{len(tiles)}Q", len(tiles), *tiles))
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        if data[:4] != b"BAI\1":
            raise ValueError("no index of a BAM file")
        at = 4

        def get(form: str) -> tuple:
            nonlocal at
            at += struct.calcsize(form)
            return struct.unpack_from(form, data, at - struct.calcsize(form))

        out = cls(get("<i")[0])
        for ref in range(len(out.bins)):
            for _ in range(get("<i")[0]):
                number, n = get("<Ii")
                out.bins[ref][number] = [list(get("<QQ")) for _ in range(n)]
            out.tiles[ref] = list(get(f"<{get('<i')[0]}Q"))
            out.bins[ref].pop(37450, None)  # totals that some writers put there
        return out


def index_of(path: str) -> Index:
    """The index of a file, read once from end to end."""
    bam = alignments.Bam(path)
    out, before = Index(len(bam.names)), (-1, -1)
    begin = bam.header_end()
    for start, stop, record in bam.placed(begin) if begin is not None else ():
        ref, pos = struct.unpack_from("<ii", record)
        here = (ref if ref >= 0 else len(bam.names), pos)
        if here < before:
            raise ValueError(f"{path} is not in order of places")
        before = here
        if ref >= 0:
            out.add(ref, max(pos, 0), max(pos + 1, alignments._record_end(record)), start, stop)
    return out


def merged(ranges: list[tuple[int, int]], gap: int = 1 << 16) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or are less than gap bytes of the file apart put together."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a >> 16 <= (out[-1][1] >> 16) + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def plan(path: str, regions: list[tuple], split: int, gap: int = 1 << 16) -> list[tuple[int, int]]:
    """Ranges of virtual offsets of a file for regions (chrom, start1, end1), of about split bytes at most: they are cut
    where a record of the linear index begins."""
    with open_file(f"{path}.bai") as f:
        index = Index.from_bytes(f.read())
    names = alignments.Bam(path).names
    found = [x for chrom, a, b in regions if chrom in names for x in index.ranges(names.index(chrom), a - 1, b)]
    cuts = sorted({t for tiles in index.tiles for t in tiles if t})
    out = []
    for a, b in merged(found, gap):
        for c in cuts:
            if a < c < b and (c >> 16) - (a >> 16) >= split:
                out.append((a, c))
                a = c
        out.append((a, b))
    return out


def write_indexes(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of the index written beside each file of a pattern; a task a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                yield pa.RecordBatch.from_pydict({"file": [file], "bytes": [write_file(f"{file}.bai", [index_of(file).to_bytes()])]})

    names = [(f,) for f, _ in alignments.files(spark, path)]
    return spark.createDataFrame(names, "file string").repartition(max(1, len(names))).mapInArrow(write, "file string, bytes long")


def planned(spark: SparkSession, names: list[str], regions: list[tuple], split: int) -> DataFrame:
    """file, start, stop (virtual offsets): what the files' indexes give for the regions, found by a task a file and dealt
    to as many tasks as there are ranges."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, *x) for f in b.column("file").to_pylist() for x in plan(f, regions, split)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "start", "stop"])

    files = spark.createDataFrame([(f,) for f in names], "file string").repartition(max(1, len(names)))
    return files.mapInArrow(find, "file string, start long, stop long").repartition("file", F.col("start"))
