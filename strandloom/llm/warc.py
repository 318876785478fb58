"""WARC archives, and their index by external merge.

Each task writes archive files of gzip members, one a record, and for each file a capture run: index
lines sorted by URL key, timestamp and page. Levels of merges by loser trees follow, FAN_IN runs to a merge,
until one run is left. Each merge is cut into key ranges of about PART_RECORDS lines that tasks merge on
their own, so tasks stay as small and as many at the last level as at the first, and a run is a list of
segments, one after the other. A task opens only the segments that its range meets (their first keys
stand in the level's table) and finds its place in them by their sparse indexes. The segments of the last run
are the index: a globally ordered capture history, however many captures one URL has.

An index line is ``urlkey timestamp page {json}``; a URL key has no byte below ``!``, so lines sort by
their bytes. A page without timestamp gets one from its page_id.

Defined cases: a null html is empty; a null url has the key ``-``; of records with equal payloads of at
least REVISIT_BYTES the one with the largest page_id is the response, and repeated rows of that page
are responses too; a null page_id is never the one referred to, unless all are null, which are then
responses; an empty table gives no archive; other columns are ignored. Line ends and blanks in a URL
are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import chain
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.common import Scratch, shared_dir, stored

REVISIT_BYTES = 1000
#: Records of an archive file and of its run, runs merged at once, records of a segment of a merged run.
RUN_RECORDS, FAN_IN, PART_RECORDS = 20_000, 64, 100_000
#: A segment's sparse index has a key for so many lines; samples of keys that a range is made of.
SPARSE, SAMPLES = 128, 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
SPACE = uuid.UUID("6f2b0c52-7d3e-5a4b-9a10-000000000000").int >> 64 << 64


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: Iterable[Iterator[bytes]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads: list[bytes | None] = [next(r, None) for r in self.runs]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.tree[node]
            if building and other < 0:  # wait here for the other side
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[bytes]:
        while self.k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and sorted query: captures of a site stand together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return quote(url, safe="")
    query = "&".join(sorted(filter(None, parts.query.split("&"))))
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + ("?" + query if query else "")
    return quote(key, safe="!#$%&'()*+,/:;=?@[]~").lower()


def record_id(page_id: int | None, digest: str) -> str:
    """A UUID that holds the page_id, or else a digest."""
    low = page_id & (1 << 64) - 1 if page_id is not None else int(digest[:16], 16)
    return f"<urn:uuid:{uuid.UUID(int=SPACE | low)}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def build_record(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None) -> tuple[bytes, str]:
    """The record's bytes and its timestamp (14 digits)."""
    sha = hashlib.sha1(payload)
    at = EPOCH + timedelta(seconds=(page_id or 0) % 315_000_000)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit_of is not None else head + payload
    fields = [
        ("WARC-Type", "response" if revisit_of is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, sha.hexdigest())),
        ("WARC-Date", at.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url:
        fields.insert(3, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if revisit_of is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(revisit_of, ""))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", at.strftime("%Y%m%d%H%M%S")


def parse_record(raw: bytes) -> dict:
    """Fields of a record, with its payload and the payload's length; a bad response raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields | {"payload": payload, "length": length, "digest": digest}


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, revisit_of: what each page's record refers to, null for a response.

    Only keys meet by digest, a partly aggregated one at that; html moves once, by page.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("revisit_of"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = keys.join(groups, "digest").filter("page_id IS NULL AND revisit_of IS NOT NULL OR page_id < revisit_of")
    revisits = revisits.distinct().withColumnsRenamed({"page_id": "p", "digest": "d"})
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", "revisit_of")


def write_run(path: str, lines: Iterable[bytes]) -> tuple[str, int, bytes]:
    """A sorted segment and, beside it, its sparse index: path, lines, first line."""
    sparse: list[str] = []
    count, first = 0, b""

    def body() -> Iterator[bytes]:
        nonlocal count, first
        at, block = 0, []
        for line in lines:
            if count % SPARSE == 0:
                sparse.append(f"{at} {line.rsplit(b' {', 1)[0].decode()}")
                first = first or line
            at += len(line) + 1
            count += 1
            block.append(line)
            if len(block) == 4096:
                yield b"\n".join(block) + b"\n"
                block = []
        if block:
            yield b"\n".join(block) + b"\n"

    store.write_file(path, body())
    store.write_file(path + ".keys", ["\n".join(sparse).encode()])
    return path, count, first


def sparse_keys(path: str) -> list[tuple[bytes, int]]:
    with store.open_file(path + ".keys") as f:
        return [(k, int(a)) for a, k in (x.split(b" ", 1) for x in f.read().splitlines())]


def read_run(path: str, low: bytes | None = None, high: bytes | None = None) -> Iterator[bytes]:
    """Lines of a run with low <= line < high."""
    at = 0
    if low is not None and (keys := sparse_keys(path)):
        at = keys[max(0, bisect_right(keys, (low, -1)) - 1)][1]
    with store.open_file(path) as f:
        f.seek(at)
        rest = b""
        while chunk := f.read(1 << 18):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                if low is not None and line < low:
                    continue
                if high is not None and line >= high:
                    return
                yield line


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """One row an archive file: its run's path, n and first line."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, runs = TaskContext.get().partitionId(), 0, []
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit_of"))))
        row = next(rows, None)
        while row is not None:
            name, index, at = f"capture-{task:06d}-{number:05d}.warc.gz", [], 0

            def members() -> Iterator[bytes]:
                nonlocal row, at
                while row is not None and len(index) < RUN_RECORDS:
                    page_id, url, html, revisit_of = row
                    raw, stamp = build_record(page_id, url, html.encode("utf-8", "surrogatepass"), revisit_of)
                    member = gzip.compress(raw, 5, mtime=0)
                    where = json.dumps({"filename": name, "offset": at, "length": len(member)})
                    index.append(f"{url_key(url)} {stamp} {(page_id or 0) + (1 << 63):020d} {where}".encode())
                    at += len(member)
                    yield member
                    row = next(rows, None)

            store.write_file(f"{folder}/{name}", members())
            index.sort()
            runs.append(write_run(f"{folder}/runs/{name}.cdx", index))
            number += 1
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs]), pa.array([r[1] for r in runs], pa.int64()), pa.array([r[2] for r in runs], pa.binary())], names=["path", "n", "low"])

    ordered = decided(pages).sortWithinPartitions("page_id", "url")
    return ordered.mapInArrow(write, "path string, n long, low binary")


def key_ranges(segments: DataFrame, target: int) -> DataFrame:
    """The merges of a level: of each group of FAN_IN runs the key ranges (part, low, high) of about target
    lines, and the segments of each run that a range meets.

    segments: run, seg, path, n, low. Only sampled keys meet in a group: SAMPLES for each target lines.
    """
    step, fan_in = max(1, target // SAMPLES // SPARSE), FAN_IN

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [[k for k, _ in sparse_keys(p)[::step]] for p in b.column("path").to_pylist()]
            group = [r // fan_in for r in b.column("run").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), *b.columns, pa.array(keys, pa.list_(pa.binary()))], names=["group", *b.schema.names, "keys"])

    def choose(rows: pa.Table) -> pa.Table:
        group = rows.column("group")[0].as_py()
        runs: dict[int, list[tuple]] = {}
        for r in sorted(zip(*(rows.column(c).to_pylist() for c in ("run", "seg", "low", "path")))):
            runs.setdefault(r[0], []).append(r[2:])
        # Each key stands for as many lines as lie behind it up to the next one of its segment.
        keys = sorted((k, min(n, (i + 1) * step * SPARSE) - i * step * SPARSE) for own, n in zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist()) for i, k in enumerate(own))
        edges, weight = [], 0
        for k, w in keys:
            if weight >= target and (not edges or k > edges[-1]):
                edges.append(k)
                weight = 0
            weight += w
        out = []
        for part, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
            met = []
            for own in runs.values():
                lows = [x[0] for x in own]
                begin = 0 if low is None else max(0, bisect_right(lows, low) - 1)
                met.append([x[1] for x in own[begin : len(own) if high is None else bisect_left(lows, high)]])
            out.append((group, part, low, high, [m for m in met if m]))
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.string()))]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["group", "part", "low", "high", "runs"])

    sampled = segments.mapInArrow(sample, "group long, run long, seg int, path string, n long, low binary, keys array<binary>")
    return sampled.groupBy("group").applyInArrow(choose, "group long, part int, low binary, high binary, runs array<array<string>>")


def merge_runs(manifest: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Merge all runs (path, n, low) into one; a row an index part, in key order: part, path, n."""
    # Runs are numbered by path, so groups have FAN_IN runs exactly; a run has RUN_RECORDS lines to a row here.
    numbered = manifest.select((F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("run"), F.lit(0).alias("seg"), "path", "n", "low")
    segments = scratch.stored(numbered, "runs")
    runs, total = segments.count(), segments.agg(F.sum("n")).head()[0] or 0
    target = max(1, min(PART_RECORDS, max(1000, total // (2 * manifest.sparkSession.sparkContext.defaultParallelism))))
    level = 0
    while runs > 1 or not level:
        runs, level = -(-runs // FAN_IN), level + 1
        spread = segments.repartition(max(1, min(segments.count(), 4096)), "path")
        ranges = scratch.stored(key_ranges(spread, target), "ranges")
        where = f"{folder}/index" if runs <= 1 else f"{folder}/level-{level}"

        def merge(batches: Iterator[pa.RecordBatch], where: str = where) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for group, part, low, high, met in zip(*(b.column(c).to_pylist() for c in ("group", "part", "low", "high", "runs"))):
                    tree = LoserTree(chain.from_iterable(read_run(p, low, high) for p in paths) for paths in met)
                    path, n, first = write_run(f"{where}/run-{group:07d}-part-{part:06d}.cdx", tree)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([part], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([first], pa.binary())], names=["run", "seg", "path", "n", "low"])

        dealt = ranges.repartitionByRange(max(1, ranges.count()), "group", "part")
        segments = scratch.stored(dealt.mapInArrow(merge, "run long, seg int, path string, n long, low binary"), "runs")
    return segments.select(F.col("seg").alias("part"), "path", "n")


def read_archives(index: DataFrame, folder: str, files: int) -> DataFrame:
    """Records of so many files, found by the merged index: page_id, url, urlkey, captured, payload_bytes, payload_digest,
    record_type, refers_to, and part and place of its line in the capture history."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, path in zip(b.column("part").to_pylist(), b.column("path").to_pylist()):
                rows: list[tuple] = []
                for place, line in enumerate(read_run(path)):
                    key, stamp, _, where = line.decode().split(" ", 3)
                    at = json.loads(where)
                    rows.append((part, place, key, stamp, at["filename"], at["offset"], at["length"]))
                    if len(rows) == 20_000:
                        yield _rows(rows, LINES)
                        rows = []
                yield _rows(rows, LINES)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, opened = io.BytesIO(), ""
        for b in batches:
            rows = []
            for part, place, key, stamp, name, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if name != opened:
                    f.close()
                    f, opened = store.open_file(f"{folder}/{name}"), name
                f.seek(offset)
                r = parse_record(gzip.decompress(f.read(length)))
                page, refers = r.get("WARC-Page-ID"), r.get("WARC-Refers-To")
                rows.append((int(page) if page else None, r.get("WARC-Target-URI"), key, stamp, r["length"], r["digest"], r["WARC-Type"], page_of(refers) if refers else None, part, place))
            yield _rows(rows, RECORDS)
        f.close()

    parts = index.count()
    found = index.select("part", "path").repartitionByRange(max(1, parts), "part").mapInArrow(lines, _ddl(LINES))
    return found.repartition(max(1, files), "filename").sortWithinPartitions("filename", "offset").mapInArrow(records, _ddl(RECORDS))


LINES = [("part", pa.int32()), ("place", pa.int64()), ("urlkey", pa.string()), ("captured", pa.string()), ("filename", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
RECORDS = [("page_id", pa.int64()), ("url", pa.string()), ("urlkey", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("history_part", pa.int32()), ("history_place", pa.int64())]


def _ddl(fields: list) -> str:
    return ", ".join(f"{n} { {'int64': 'long', 'int32': 'int', 'string': 'string'}[str(t)]}" for n, t in fields)


def _rows(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def archive(pages: DataFrame) -> tuple[DataFrame, str, int]:
    """Write archives and their merged index below the shared folder: the index parts, the folder, and the
    number of archive files."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    with Scratch(spark, "warc-merge") as scratch:
        runs = scratch.stored(write_archives(pages, folder), "manifest")
        index = stored(merge_runs(runs, folder, scratch), "warc-index")
        return index, folder, runs.count()
