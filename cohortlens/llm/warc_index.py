"""WARC archives of captured pages with a two-level capture index.

``write_archives`` writes one gzip member per record.  Of equal payloads the one
of the smallest id is a ``response``, the others are ``revisit`` records that
refer to it.  ``write_index`` sorts the captures by key -- the URL with its host
reversed (``com,example)/path``), so that a site's captures lie together --
and writes them as lines in compressed blocks; the directory has one entry a
block (its first key and its place).  ``find_captures`` looks keys up: binary
search in the directory, a range read of the few blocks that can hold the key,
and a search in their lines.  ``read_captures`` reads the records by ranges of
the archives, each file from front to back.

Every file is written whole by one task under a name of its own attempt, and
only names in a stored table count, so a lost executor or a second attempt
leaves at most a file that nothing refers to.  Files are reached with
``pyarrow.fs`` from the workers (any folder that all executors share and
pyarrow opens by its URI); pages move through Spark only.

The directory is broadcast; it has at most ``DIRECTORY`` entries and one more for
each index file, as blocks hold more lines the more captures there are.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import scratch_table, ship, stored

#: Least lines of a block, most directory entries, bytes from which an archive is closed, rows broadcast at most.
BLOCK_LINES, DIRECTORY, ARCHIVE_BYTES, BROADCAST_ROWS = 3000, 100_000, 1 << 28, 1_000_000
#: Gzip level of records and blocks, bytes read ahead in an archive.
LEVEL, READ_AHEAD = 6, 1 << 20
#: Capture time written in records (the table has none).
CAPTURED = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host reversed, port 80 or 443, user, ``#`` part
    and scheme left out; ``-`` for none."""
    if not url or not url.strip():
        return "-"
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip()).split("#", 1)[0]
    cut = re.search(r"[/?]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "")
    path = path if path.startswith("/") else "/" + path
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", f"{labels}){path}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {CAPTURED}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(raw: bytes) -> dict:
    """The parts of one record; raises on a damaged one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    length = int(warc["content-length"])
    if not head.startswith(b"WARC/1.") or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    revisit = warc["warc-type"] == "revisit"
    digest, n = warc["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    if not revisit and (len(payload) != n or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {warc['warc-record-id']} doesn't match its digest")
    return {
        "page_id": _page(warc["warc-record-id"]),
        "url": warc.get("warc-target-uri"),
        "record_type": warc["warc-type"],
        "refers_to": _page(warc.get("warc-refers-to")) if revisit else None,
        "payload_bytes": n,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as Hadoop writes it (``file:/...`` too)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Output:
    """Files of one task, each under a fresh name: ``place(data)`` appends and
    gives the file's name and the offset."""

    def __init__(self, folder: str, suffix: str, most: int):
        self.fs, self.root = _opened(folder)
        self.suffix, self.most, self.out = suffix, most, None

    def place(self, data: bytes) -> tuple[str, int]:
        if self.out is not None and self.at >= self.most:
            self.close()
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


@dataclass(frozen=True)
class Archive:
    """A folder of archives, the stored captures in it, and its index."""

    folder: str
    captures: DataFrame
    directory: DataFrame | None = None


def _new_folder(docs: DataFrame) -> str:
    folder = scratch_table(docs.sparkSession)
    fs, path = _opened(folder)
    fs.create_dir(path, recursive=True)
    return folder


def write_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> Archive:
    """Write a record per row of ``pages``.

    A null payload is empty; a null URL is left out of the record and has key
    ``-``.  Rows whose payload equals that of a row with a smaller id are revisits
    (a null id is larger than all others); rows of the same id and payload are all
    responses if the id is the smallest.  Equal payloads are found by SHA-1 and
    length with a map-side combined aggregate; only payloads that occur under
    several ids are joined back (broadcast up to ``BROADCAST_ROWS`` of them).
    Other columns are ignored; an empty table writes nothing.
    """
    ship(pages.sparkSession)
    folder = folder or _new_folder(pages)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.cast("binary").alias("payload")
    )
    keyed = base.withColumns({"digest": F.unhex(F.sha1("payload")), "n": F.octet_length("payload")})
    ids = F.coalesce(F.min("page_id") < F.max("page_id"), F.lit(False)) | (F.count("page_id") < F.count(F.lit(1)))
    first = keyed.groupBy("digest", "n").agg(F.min("page_id").alias("first"), ids.alias("several"))
    first = stored(first.where("several AND first IS NOT NULL").drop("several"))
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    typed = keyed.join(first, ["digest", "n"], "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(folder, "warc.gz", archive_bytes)
        for batch in _rows(batches):
            rows = {"key": [], "page_id": batch.column("page_id"), "file": [], "offset": [], "length": []}
            for p in batch.to_pylist():
                revisit = p["first"] is not None and p["page_id"] != p["first"]
                data = _member(record(p["page_id"], p["url"], p["payload"], p["first"], revisit))
                name, at = out.place(data)
                for c, v in (("key", url_key(p["url"])), ("file", name), ("offset", at), ("length", len(data))):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_CAPTURE_ARROW)
        out.close()

    return Archive(folder, stored(typed.mapInArrow(write, _CAPTURE)))


_CAPTURE_ARROW = pa.schema(
    [("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def _line(row: dict) -> bytes:
    rest = {k: row[k] for k in ("page_id", "file", "offset", "length")}
    return f"{row['key']} {json.dumps(rest, separators=(',', ':'))}\n".encode()


def write_index(archive: Archive, block_lines: int = BLOCK_LINES, directory: int = DIRECTORY) -> Archive:
    """The archive with its index: lines sorted by (key, page_id, place), so that
    the captures of one URL, however many, may lie in several files and blocks."""
    captures, folder = archive.captures, archive.folder
    lines = max(block_lines, -(-captures.count() // directory))
    order = ["key", "page_id", "file", "offset"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, entries = _Output(folder, "cdx.gz", 1 << 62), [], []

        def block() -> None:
            data = _member(b"".join(map(_line, held)))
            name, at = out.place(data)
            entries.append((held[0]["key"], held[0]["page_id"], name, at, len(data)))
            held.clear()

        for batch in _rows(batches, 1024):
            for row in batch.to_pylist():
                held.append(row)
                if len(held) >= lines:
                    block()
        if held:
            block()
        out.close()
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries), _CAPTURE_ARROW)], schema=_CAPTURE_ARROW)

    blocks = captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, _CAPTURE)
    return Archive(folder, captures, stored(blocks))


class Directory:
    """First keys of the blocks in order, with the places of the blocks."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["key"].encode(), r["page_id"] is not None, r["page_id"] or 0, r["file"], r["offset"]))
        self.first = [r["key"].encode() for r in rows]
        self.place = [(r["file"], r["offset"], r["length"]) for r in rows]

    def blocks(self, key: str) -> range:
        """Numbers of the blocks that can hold the key: a block ends where the
        next begins, with the same key perhaps."""
        k = key.encode()
        return range(max(0, bisect.bisect_left(self.first, k) - 1), bisect.bisect_right(self.first, k))


def find_captures(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """The captures (``key, page_id, file, offset, length``) of every URL in
    ``urls``, each once however often a URL is asked for."""
    spark, folder = urls.sparkSession, archive.folder
    ship(spark)
    directory = spark.sparkContext.broadcast(Directory(archive.directory.collect()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted({url_key(u) for u in batch.column("url").to_pylist()}), pa.string())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [(b, k) for k in batch.column("key").to_pylist() for b in directory.value.blocks(k)]
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([b for b, _ in asked], pa.int64()), "key": pa.array([k for _, k in asked], pa.string())}
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        now, lines = None, {}
        for batch in _rows(batches, 1024):
            found = []
            for b, key in zip(batch.column("block").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if b != now:
                    name, at, n = directory.value.place[b]
                    with fs.open_input_file(f"{root}/{name}") as f:
                        raw = f.read_at(n, at)
                    now, lines = b, {}
                    for line in zlib.decompress(raw, 31).split(b"\n")[:-1]:
                        k, _, rest = line.partition(b" ")
                        lines.setdefault(k, []).append(rest)
                found += [{"key": key, **json.loads(rest)} for rest in lines.get(key.encode(), ())]
            for i in range(0, len(found), 1024):
                yield pa.RecordBatch.from_pylist(found[i : i + 1024], schema=_CAPTURE_ARROW)

    asked = urls.select(F.col(url).cast("string").alias("url")).mapInArrow(keys, "key string").distinct()
    blocks = asked.mapInArrow(search, "block bigint, key string")
    return stored(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(scan, _CAPTURE))


def read_captures(archive: Archive, captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records at the captures' places: ``page_id, url, record_type,
    refers_to, payload_bytes, payload_digest`` and, if wanted, ``payload`` (null
    for revisits).  Payloads are checked against their digests."""
    folder = archive.folder
    kept = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            *([("payload", pa.binary())] if payload else []),
        ]
    )
    ddl = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        name, f = None, None
        for batch in _rows(batches, 128):
            out = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f, ahead, start = file, fs.open_input_file(f"{root}/{file}"), b"", 0
                if not (start <= at and at + n <= start + len(ahead)):  # neighbours come with one range read
                    ahead, start = f.read_at(max(n, READ_AHEAD), at), at
                out.append(parse(zlib.decompress(ahead[at - start : at - start + n], 31)))
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in kept.names} for r in out], schema=kept)
        if f is not None:
            f.close()

    ordered = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, ddl + (", payload binary" if payload else ""))


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, index them, look all URLs
    up and read the records found."""
    archive = write_index(write_archives(pages))
    return read_captures(archive, find_captures(archive, pages), payload=False)
