"""WARC archives with a two-level capture index.

``write`` puts a record per page into archives of the shared folder, every record
a gzip member of its own, so that one can be read by its range. Of records with
equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is a
response, the others are revisits that name it and its digest and carry no
payload.

``build_index`` sorts the captures by reversed-host URL key and id into index
parts, each made of gzip blocks of ``BLOCK_LINES`` lines, and keeps a sparse
directory: the first key of every block, beside its part. ``lookup`` sends each
wanted key to its part by the parts' first keys, finds the block by binary
search in that part's directory, reads the range of the block and searches the
lines; ``read`` reads the ranges of the archives and parses the records. The
directory of a part is all that a task holds; the first keys of the parts (one
per part) are all that the driver holds.

Archives and parts are named by partition and attempt, and only those of finished
tasks are listed in the index, so a task that runs again leaves at most a file
that nothing refers to.

Null pages are empty. A null or empty URL has an empty key. Rows with equal ids
and payloads are all responses if theirs is the smallest id; a null id is larger
than all others. An empty table gives no archives and no captures. Further
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import shared_folder, stored

MIN_REVISIT = 100
BLOCK_LINES = 1_000
PART_LINES = 200_000
ROWS = 256
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Neighbouring ranges are read at once up to this gap and size.
GAP, READ = 64 << 10, 4 << 20


def url_key(url: str | None) -> str:
    """The host reversed, then the path and the sorted query; no scheme, "www.",
    port, user or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    path = parts.path.lower().rstrip("/") or "/"
    return ",".join(reversed(host.split("."))) + ")" + path + ("?" + query if query else "")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, name: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC 1.1 record; a revisit has the digest of the payload it leaves out."""
    body = b"" if kind == "revisit" else payload
    ident = uuid.uuid5(uuid.NAMESPACE_URL, name)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{ident}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {name}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head.insert(6, f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers_to)}>")
        head.append(f"X-Refers-To-Page: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; a damaged one raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    size = int(headers["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def _name(prefix: str) -> str:
    context = TaskContext.get()
    return f"{prefix}-{context.partitionId():06d}-{context.taskAttemptId()}"


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; a row per record: ``urlkey, page, url, kind, digest,
    file, offset, length``. The rows are stored."""
    rows = pages.select(
        F.col(key).alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    # Which payloads repeat is settled on digests alone; the pages move once.
    large = rows.filter(F.octet_length("html") >= MIN_REVISIT).select("page", "digest")
    many = large.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    many = stored(many.filter("n > 1").select("digest", "first"), "digests")
    rows = rows.join(many, "digest", "left").select("page", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name, out, offset = "", None, 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if out is None:
                    name = _name("pages") + ".warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                found = []
                for page, link, text, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = text.encode("utf-8", "surrogatepass")
                    revisit = first is not None and page != first
                    kind = "revisit" if revisit else "response"
                    data = _member(record(kind, str(page), link, payload, digest, str(first) if revisit else None))
                    out.write(data)
                    found.append((url_key(link), kind, name, offset, len(data)))
                    offset += len(data)
                keys, kinds, files, offsets, lengths = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column(0), batch.column(1), pa.array(kinds), batch.column(3), pa.array(files),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["urlkey", "page", "url", "kind", "digest", "file", "offset", "length"],
                )
        if out is not None:
            out.close()

    kind = rows.schema["page"].dataType.simpleString()
    schema = f"urlkey string, page {kind}, url string, kind string, digest string, file string, offset long, length long"
    return stored(rows.mapInArrow(run, schema), "captures")


@dataclass(frozen=True)
class CaptureIndex:
    """``folder`` has the archives and the index parts; ``parts`` the first key of
    each part and its name, in order."""

    folder: str
    parts: list[tuple[str, str]]


# A line of the index: key, page, file, offset, length. Tabs can't be in a key.
def _sort_key(urlkey: str, page: object) -> str:
    return urlkey.replace("\t", "%09").replace("\n", "%0A") + "\t" + str(page)


def build_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Write the sorted blocks and the sparse directories."""
    n = captures.count()
    parts = max(1, math.ceil(n / PART_LINES), min(captures.sparkSession.sparkContext.defaultParallelism, math.ceil(n / BLOCK_LINES)))
    line_key = F.concat(F.regexp_replace(F.regexp_replace("urlkey", "\t", "%09"), "\n", "%0A"), F.lit("\t"),
                        F.coalesce(F.col("page").cast("string"), F.lit("None")))
    # Equal keys (rows with one URL and id) spread by their place in the archives.
    ordered = captures.select(line_key.alias("line_key"), "file", "offset", "length")
    ordered = ordered.repartitionByRange(parts, "line_key", "file", "offset")
    ordered = ordered.sortWithinPartitions("line_key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, offset, block, directory = None, "", 0, [], []

        def flush() -> None:
            nonlocal offset
            data = _member("\n".join(block).encode())
            directory.append((block[0].rsplit("\t", 3)[0], offset, len(data)))
            out.write(data)
            offset += len(data)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = _name("index")
                    out = store.open_output_stream(f"{base}/{name}.gz", compression=None)
                block.append("\t".join(map(str, row)))
                if len(block) == BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            out.close()
            with store.open_output_stream(f"{base}/{name}.blocks", compression=None) as sparse:
                sparse.write("\n".join("\t".join(map(str, d)) for d in directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first", "name"])

    listed = stored(ordered.mapInArrow(run, "first string, name string"), "index-parts").collect()  # a row per part
    return CaptureIndex(folder, sorted((r["first"], r["name"]) for r in listed))


class _Part:
    """Binary search in one part of the index."""

    def __init__(self, folder: str, name: str):
        self.store, self.base = _open(folder)
        self.name = name
        with self.store.open_input_stream(f"{self.base}/{name}.blocks", compression=None) as sparse:
            rows = [line.rsplit("\t", 2) for line in sparse.read().decode().split("\n")]
        self.firsts = [r[0] for r in rows]
        self.ranges = [(int(r[1]), int(r[2])) for r in rows]
        self.file = self.store.open_input_file(f"{self.base}/{name}.gz")
        self.block, self.lines, self.keys = -1, [], []

    def _load(self, block: int) -> None:
        if block != self.block:
            offset, length = self.ranges[block]
            self.file.seek(offset)
            self.lines = zlib.decompress(self.file.read(length), 31).decode().split("\n")
            self.keys = [line.rsplit("\t", 3)[0] for line in self.lines]
            self.block = block

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Places of all lines with the key, also over several blocks."""
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.firsts) and self.firsts[block] <= key:
            self._load(block)
            for i in range(bisect.bisect_left(self.keys, key), len(self.keys)):
                if self.keys[i] != key:
                    return
                _, file, offset, length = self.lines[i].rsplit("\t", 3)
                yield file, int(offset), int(length)
            block += 1


def lookup(index: CaptureIndex, wanted: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``file, offset, length`` of the captures of ``wanted(url, key)``, without
    repeats."""
    folder, parts = index.folder, index.parts
    firsts = [p[0] for p in parts]
    spark = wanted.sparkSession
    schema = "file string, offset long, length long"
    if not parts:
        return spark.createDataFrame([], schema)
    asked = wanted.select(F.col(url).alias("url"), F.col(key).cast("string").alias("page"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, of = [], []
            for link, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = _sort_key(url_key(link), page)
                # A key may run over from the part before the one that begins with it.
                low = max(0, bisect.bisect_left(firsts, k) - 1)
                high = bisect.bisect_right(firsts, k)
                for part in range(low, max(high, low + 1)):
                    keys.append(k), of.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(of, pa.int32())], ["k", "part"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = None, -1
        for batch in batches:
            found = []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != number:
                    part, number = _Part(folder, parts[p][1]), p
                found += part.find(k)
            files, offsets, lengths = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["file", "offset", "length"],
            )

    distinct = asked.mapInArrow(keyed, "k string, part int").distinct()
    return distinct.repartitionByRange("part", "k").sortWithinPartitions("part", "k").mapInArrow(find, schema)


def read(index: CaptureIndex, places: DataFrame) -> DataFrame:
    """The records at ``file, offset, length``: type, id, URL, digest, whether the
    payload agrees with it, length, and the page a revisit refers to."""
    folder = index.folder
    schema = (
        "page string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, "
        "payload binary"
    )

    def records(store: fs.FileSystem, path: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
        with store.open_input_file(path) as file:
            at = 0
            while at < len(ranges):
                begin = ranges[at][0]
                end, last = sum(ranges[at]), at + 1
                while last < len(ranges) and ranges[last][0] <= end + GAP and sum(ranges[last]) - begin <= READ:
                    end, last = sum(ranges[last]), last + 1
                file.seek(begin)
                data = file.read(end - begin)
                for offset, length in ranges[at:last]:
                    yield zlib.decompress(data[offset - begin : offset - begin + length], 31)
                at = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                by_file: dict[str, list[tuple[int, int]]] = {}
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    by_file.setdefault(file, []).append((offset, length))
                out = []
                for file, ranges in by_file.items():
                    for data in records(store, f"{base}/{file}", ranges):
                        headers, body = parse(data)
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(headers["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                            raise ValueError(f"payload and digest differ in {file}")
                        out.append((headers["X-Page-ID"], headers.get("WARC-Target-URI", ""), kind, digest, size,
                                    headers.get("X-Refers-To-Page"), body))
                types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                columns = [*zip(*out, strict=True)] or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["page", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"],
                )

    ordered = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive all pages, index them, look every one up and read it back."""
    folder = shared_folder(pages.sparkSession, "warc")
    index = build_index(write(pages, folder, key, url, html), folder)
    back = read(index, lookup(index, pages.select(key, url), key, url))
    kind = pages.schema[key].dataType

    def page(column: str):
        return F.when(F.col(column) != "None", F.col(column)).cast(kind)

    return back.select(
        page("page").alias(key), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
