"""Block-compressed shards: joined they are one sorted file with one end marker, and the index leads to its lines."""

import glob
import gzip
import random
import struct
import zlib

from pyspark.sql import functions as F

from strandloom.sources import bgzf
from strandloom.sources.alignments import EOF


def test_shards_join_and_their_index_leads_to_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bgzf, "BLOCK", 2000)
    g = random.Random(5)
    rows = sorted({(g.choice("ab"), g.randrange(1, 400_000)) for _ in range(5000)})
    df = spark.createDataFrame(rows, "chrom string, pos long").withColumn("value", F.concat_ws("\t", "chrom", "pos", F.repeat(F.lit("x"), F.expr("int(pos % 90)")))).repartition(5)
    folder = str(tmp_path / "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = bgzf.write_lines(df, ["chrom", "pos"], folder, ["#CHROM\tPOS\tX"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = sorted(glob.glob(f"{folder}/part-*.gz"))
    whole = b"".join(open(p, "rb").read() for p in shards)
    assert len(shards) > 4 and whole.endswith(EOF) and whole.count(EOF) == 1
    lines = gzip.decompress(whole).decode().splitlines()
    text = [f"{c}\t{p}\t{'x' * (p % 90)}" for c, p in rows]
    assert lines == ["#CHROM\tPOS\tX", *text]
    # Every offset of the joined file is that of a tile's first line.
    for r in index:
        at, inside = r.offset >> 16, r.offset & 0xFFFF
        data = b""
        while len(data) < inside + 200 and at < len(whole):
            size = struct.unpack_from("<H", whole, at + 16)[0] + 1
            data += zlib.decompress(whole[at + 18 : at + size - 8], -15)
            at += size
        c, p, _ = data[inside:].split(b"\n")[0].decode().split("\t")
        assert c == r.chrom and int(p) >> bgzf.TILE == r.tile
    regions = [("a", 100, 30_000), ("b", 200_000, 200_400), ("b", 399_000, 500_000), ("c", 1, 9)]
    got = sorted(x.value for x in bgzf.fetch(spark, folder, regions).collect())
    assert got == sorted(t for t, (c, p) in zip(text, rows) if any(c == x and a <= p <= b for x, a, b in regions)) and got
    none = str(tmp_path / "none")
    assert bgzf.write_lines(df.filter("false"), ["chrom", "pos"], none, []).count() == 0
    assert gzip.decompress(b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{none}/part-*.gz")))) == b""
