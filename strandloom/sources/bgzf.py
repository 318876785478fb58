"""Sorted lines as block-compressed shards, which joined in the order of their names are one file, and an index of its
virtual offsets.

Tasks write the ranges of a range sort, each as one shard of blocks; the head and the end marker are shards of their own,
so no task needs to know whether it is the first or the last. Each task tells where in its shard the first line of each
tile of 16 kb stands; the sizes of the shards before, a row a shard, make file offsets of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.sources.alignments import EOF, _Blocks, _bgzf, _Stream
from strandloom.sources.files import open_file, write_file
from strandloom.sources.storage import Scratch

TILE, BLOCK = 14, 60_000
INDEX = "part int, path string, bytes long, chrom string, tile long, at long"


def write_lines(lines: DataFrame, order: list[str], folder: str, head: list[str]) -> DataFrame:
    """Write lines (chrom, pos, value and the columns of order) as shards below folder, in order; returns the index:
    chrom, tile, part, path, at (virtual offset in the shard), offset (in the joined file). It is also written there."""
    spark = lines.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() + 1
        path, tiles, size = f"{folder}/part-{part:06d}.gz", [], 0

        def blocks() -> Iterator[bytes]:
            nonlocal size
            data, last = bytearray(), None
            for b in batches:
                for chrom, pos, value in zip(*(b.column(c).to_pylist() for c in ("chrom", "pos", "value"))):
                    if (here := (chrom, pos >> TILE)) != last:
                        tiles.append((*here, size << 16 | len(data)))
                        last = here
                    data += value.encode() + b"\n"
                    while len(data) >= BLOCK:
                        out = _bgzf(bytes(data[:BLOCK]))
                        del data[:BLOCK]
                        size += len(out)
                        yield out
            if data:
                out = _bgzf(bytes(data))
                size += len(out)
                yield out

        write_file(path, blocks())
        rows = [(part, path, size, None, None, None), *((part, path, size, *t) for t in tiles)]
        types = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["part", "path", "bytes", "chrom", "tile", "at"])

    first = [_bgzf("".join(f"{x}\n" for x in head).encode())] if head else []
    start = write_file(f"{folder}/part-000000.gz", first)
    write_file(f"{folder}/part-999999.gz", [EOF])
    with Scratch(spark, "bgzf") as scratch:
        rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("chrom", "pos", "value")
        found = scratch.stored(rows.mapInArrow(write, INDEX), "shards")
        base = F.coalesce(F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + start  # a row a shard
        bases = found.filter("chrom IS NULL").select("part", base.alias("base"))
        index = found.filter("chrom IS NOT NULL").join(bases, "part")
        offset = F.shiftleft(F.col("base") + F.shiftright("at", 16), 16) + F.col("at").bitwiseAND(0xFFFF)
        index.select("chrom", "tile", "part", "path", "at", offset.alias("offset")).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _lines_from(path: str, at: int) -> Iterator[str]:
    """Lines of a shard from a virtual offset on, which may be a line's place in a block or behind the block's end."""
    with open_file(path) as f:
        stream = _Stream(_Blocks(f, at >> 16))
        left, skip = b"", at & 0xFFFF
        while stream.at < len(stream.data) or stream._grow():
            if skip:
                while len(stream.data) - stream.at < skip and stream._grow():
                    pass
                stream.take(min(skip, len(stream.data) - stream.at))
                skip = 0
                continue
            *whole, left = (left + stream.take(len(stream.data) - stream.at)).split(b"\n")
            yield from (x.decode() for x in whole)
        if left:
            yield left.decode()


def fetch(spark: SparkSession, folder: str, regions: list[tuple[str, int, int]]) -> DataFrame:
    """chrom, pos, value of the lines (chromosome and place being the first two fields) in regions (chrom, first, last): a
    task opens a shard where the index says and stops behind the region."""
    index = spark.read.parquet(f"{folder}/index")
    wanted = spark.createDataFrame([(i, c, a, b) for i, (c, a, b) in enumerate(regions)], "region int, chrom string, first long, last long")
    met = index.join(F.broadcast(wanted), "chrom").filter(F.col("tile").between(F.shiftright("first", TILE), F.shiftright("last", TILE)))  # the regions asked for
    starts = met.groupBy("region", "chrom", "first", "last", "path").agg(F.min("at").alias("at")).repartition("path", "region")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chrom, first, last, path, at in zip(*(b.column(c).to_pylist() for c in ("chrom", "first", "last", "path", "at"))):
                rows = []
                for line in _lines_from(path, at):
                    c, p, _ = line.split("\t", 2)
                    if c != chrom or int(p) > last:
                        break
                    if int(p) >= first:
                        rows.append((c, int(p), line))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["chrom", "pos", "value"])

    return starts.mapInArrow(read, "chrom string, pos long, value string")
