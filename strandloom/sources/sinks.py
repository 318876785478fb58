"""Sinks: records, reads, graphs, alignments and reports as text; Parquet and TSV by Spark's writers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from datetime import date
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators.evidence import record_text
from strandloom.sources.files import open_file, write_file
from strandloom.sources.storage import checkpointed

#: Characters of a batch of texts.
BATCH = 1 << 20
#: Hues of walks; a walk's is its number modulo this.
PALETTE = 64

INFO = {
    "SHARED": ("0", "Flag", "ALT seen in case and control samples"),
    "CTRL": ("0", "Flag", "ALT seen in control samples only"),
    "CASE": ("0", "Flag", "ALT seen in case samples only"),
    "TYPE": ("A", "String", "Variant type (SNV, INS, DEL, MNP, CPX)"),
    "LENGTH": ("A", "Integer", "Variant length in bases, negative for deletions"),
    "MULTIALLELIC": ("0", "Flag", "Site with several ALT alleles"),
}
FORMATS = {
    "GT": ("1", "String", "Genotype"), "AD": ("R", "Integer", "Allele depth"), "ADF": ("R", "Integer", "Allele depth, forward strand"), "ADR": ("R", "Integer", "Allele depth, reverse strand"),
    "DP": ("1", "Integer", "Read depth"), "RMQ": ("R", "Float", "RMS mapping quality by allele"), "NPBQ": ("R", "Float", "Posterior base quality over allele depth"), "SB": ("1", "Float", "Strand bias log odds"),
    "SCA": ("1", "Float", "Soft clip asymmetry"), "FLD": ("1", "Float", "Fragment length delta"), "RPCD": ("1", "Float", "Read position effect size"), "BQCD": ("1", "Float", "Base quality effect size"),
    "MQCD": ("1", "Float", "Mapping quality effect size"), "ASMD": ("1", "Float", "Mismatch delta less variant length"), "SDFC": ("1", "Float", "Depth over window coverage"), "PRAD": ("1", "Float", "Polar radius of depths"),
    "PANG": ("1", "Float", "Polar angle of depths"), "CMLOD": ("A", "Float", "Mixture log odds by ALT"), "FSSE": ("1", "Float", "Fragment start entropy"), "AHDD": ("1", "Float", "ALT haplotype discordance delta"),
    "HSE": ("1", "Float", "Haplotype segregation entropy"), "PDCV": ("1", "Float", "Path depth variation"), "PL": ("G", "Integer", "Phred-scaled genotype likelihoods"), "GQ": ("1", "Integer", "Genotype quality"),
}


def vcf_header(contigs: list[tuple[str, int]], samples: list[str], case_control: bool, reference: str = "", day: date | None = None) -> list[str]:
    """Header lines; SHARED, CTRL and CASE are told of only where there are case samples."""
    line = lambda kind, name, x: f'##{kind}=<ID={name},Number={x[0]},Type={x[1]},Description="{x[2]}">'
    info = [line("INFO", k, v) for k, v in INFO.items() if case_control or k not in ("SHARED", "CTRL", "CASE")]
    out = ["##fileformat=VCFv4.5", f"##fileDate={(day or date.today()):%Y%m%d}", "##source=strandloom"]
    out += [f'##reference="{reference}"'] * bool(reference) + [f"##contig=<ID={n},length={size}>" for n, size in contigs]
    out += info + [line("FORMAT", k, v) for k, v in FORMATS.items()]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_vcf(sites: DataFrame, header: list[str], chrom_order: list[str], path: str) -> None:
    """Sites in genome order as text parts below path, which joined in name order are one VCF file.

    The range sort keeps parts in order; the header is the first lines of the first part.
    """
    order = F.array_position(F.array(*map(F.lit, chrom_order)), F.col("chrom")).cast("int")
    body = sites.select(order.alias("c"), F.col("pos").alias("p"), F.col("ref").alias("r"), record_text().alias("value"))
    head = sites.sparkSession.createDataFrame([(-1, i, "", x) for i, x in enumerate(header)], "c int, p long, r string, value string")
    body = checkpointed(body, "vcf-lines")  # or the range sort's sample makes all lines a second time
    head.unionByName(body).orderBy("c", "p", "r").select("value").write.mode("overwrite").text(path)


def sam_line() -> Column:
    """A SAM line of alignment columns."""
    quals = F.when(F.col("quals").isNull(), "*").otherwise(F.array_join(F.transform("quals", lambda q: F.chr(q + 33)), ""))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"])), "\t")
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(F.col("mate_chrom"))
    base = [F.col("qname"), F.col("flag"), F.col("chrom"), F.col("pos"), F.col("mapq"), F.col("cigar"), mate, F.col("mate_pos"), F.col("tlen"), F.col("seq"), quals]
    return F.concat_ws("\t", *(c.cast("string") for c in base), F.when(F.size("tags") > 0, tags))


def probe_records(probes: DataFrame, records: DataFrame) -> DataFrame:
    """All records, and for probes without any a row of nulls: what a probe report holds."""
    return probes.join(records, "probe_id", "left")


def dot_graph(nodes: DataFrame, edges: DataFrame, key: str, walks: DataFrame | None = None) -> DataFrame:
    """key, dot: graphs in DOT. Nodes (key, node, seq, label, cov) have the colour of their role; edges lie above them, and
    walks (key, walk, step, node) above all, each in one of PALETTE hues; walk 0 is the reference's, in black."""
    colour = F.when(F.col("label") == "REF", "steelblue").when(F.col("label") == "CASE", "indianred").when(F.col("label") == "CTRL", "mediumseagreen").otherwise("lightblue")
    n = nodes.select(key, F.format_string('"%s" [fillcolor="%s" style="filled" label="%s" coverage=%d];', F.col("node"), colour, F.col("seq"), F.col("cov").cast("int")).alias("line"), F.lit(0).alias("z"))
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    layers = n.union(edges.select(key, F.format_string('"%s" -> "%s" [taillabel="%s" headlabel="%s"];', "src", "dst", sign("src_plus"), sign("dst_plus")).alias("line"), F.lit(1).alias("z")))
    if walks is not None:
        order = W.partitionBy(key, "walk").orderBy("step")
        steps = walks.withColumn("to", F.lead("node").over(order)).filter("to IS NOT NULL").select(key, "walk", "node", "to").distinct()
        hue = F.when(F.col("walk") == 0, F.lit("black")).otherwise(F.format_string("%.4f 0.9 0.8", (F.col("walk") % PALETTE) / F.lit(PALETTE)))
        layers = layers.union(steps.select(key, F.format_string('"%s" -> "%s" [color="%s" penwidth=2];', F.col("node"), F.col("to"), hue).alias("line"), F.lit(2).alias("z")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "line"))), lambda x: x["line"]), "\n")
    return layers.groupBy(key).agg(F.concat(F.lit("strict digraph G {\n"), body, F.lit("\n}")).alias("dot"))


class _Pieces:
    """What a writer has written and nobody has taken yet."""

    def __init__(self):
        self.held: list[bytes] = []

    def write(self, data: bytes) -> int:
        self.held.append(bytes(data))
        return len(data)

    def taken(self) -> Iterator[bytes]:
        held, self.held = self.held, []
        yield from held


def _archive(rows: Iterator[tuple[str, str | None]]) -> Iterator[bytes]:
    """A tar.gz of texts, piece by piece."""
    pieces = _Pieces()
    with tarfile.open(fileobj=pieces, mode="w|gz") as tar:
        for name, text in rows:
            data = (text or "").encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            tar.members.clear()  # or it keeps them all
            yield from pieces.taken()
    yield from pieces.taken()


def write_archive(texts: DataFrame, folder: str) -> DataFrame:
    """Write texts (name, text) into one tar.gz a task, and return path, n of each; archives that are written one after
    the other into one file can be read as one (tar's -i). A task that runs twice leaves one whole archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((n, t) for b in batches for n, t in zip(b.column("name").to_pylist(), b.column("text").to_pylist()))
        first, count = next(rows, None), 0
        if first is None:
            return
        path = f"{folder}/shard-{TaskContext.get().partitionId():06d}.tar.gz"

        def counted() -> Iterator[tuple[str, str | None]]:
            nonlocal count
            for r in chain([first], rows):
                count += 1
                yield r

        write_file(path, _archive(counted()))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "n"])

    return texts.select("name", "text").mapInArrow(write, "path string, n long")


def _members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The members of an archive, none of which it keeps in memory."""
    while (m := tar.next()) is not None:
        tar.members.clear()
        yield m


def read_archives(shards: DataFrame) -> DataFrame:
    """name, text of the archives of write_archive()."""

    def batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["name", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            with open_file(path) as f, tarfile.open(fileobj=f, mode="r:gz") as tar:
                each = ((m.name, tar.extractfile(m).read().decode()) for m in _members(tar))
                held, size = [], 0
                for name, text in each:
                    held.append((name, text))
                    size += len(text)
                    if size >= BATCH or len(held) == 1024:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return shards.select("path").mapInArrow(read, "name string, text string")


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Write texts (name, text) as files of a folder: path of each. Whoever writes a file twice leaves it whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [f"{folder}/{n}" for n in b.column("name").to_pylist()]
            for path, t in zip(paths, b.column("text").to_pylist()):
                write_file(path, [(t or "").encode()])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return texts.select("name", "text").mapInArrow(write, "path string")


def gfa(nodes: DataFrame, edges: DataFrame, paths: DataFrame, key: str, k: int) -> DataFrame:
    """key, gfa: version 1 with S, L and P lines; nodes (node, seq), edges as of kgraph, paths (name, steps)."""
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    s = nodes.select(key, F.lit(1).alias("z"), F.concat_ws("\t", F.lit("S"), "node", "seq").alias("line"))
    l = edges.select(key, F.lit(2).alias("z"), F.concat_ws("\t", F.lit("L"), "src", sign("src_plus"), "dst", sign("dst_plus"), F.lit(f"{k - 1}M")).alias("line"))
    p = paths.select(key, F.lit(3).alias("z"), F.concat_ws("\t", F.lit("P"), "name", F.array_join("steps", ","), F.lit("*")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "line"))), lambda x: x["line"]), "\n")
    return s.union(l).union(p).groupBy(key).agg(F.concat(F.lit("H\tVN:Z:1.0\n"), body).alias("gfa"))


def fasta_text(rows: DataFrame, key: str) -> DataFrame:
    """key, fasta of rows (key, name, seq, ord)."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "seq"))), lambda x: F.concat(F.lit(">"), x["name"], F.lit("\n"), x["seq"]))
    return rows.groupBy(key).agg(F.array_join(body, "\n").alias("fasta"))


def write_tsv(df: DataFrame, path: str) -> None:
    """A report with a header line; nulls are dots."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c in df.columns)).write.mode("overwrite").csv(path, sep="\t", header=True)


def scored(sites: DataFrame, passing: Column, probabilities: Column) -> DataFrame:
    """QUAL from the least class probability of a model; sites that the model passes are PASS from 10 for SNVs (one base
    for another) and from 13 for others, the filter of all others stays as it is."""
    q = sites.withColumn("qual", seq.prob_to_phred(F.array_min(probabilities)))
    snv = (F.length("ref") == 1) & (F.length(F.col("alts")[0]) == 1)
    return q.withColumn("filter", F.when(passing & (F.col("qual") >= F.when(snv, 10).otherwise(13)), "PASS").otherwise(F.col("filter")))
