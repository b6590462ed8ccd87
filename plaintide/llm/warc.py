"""WARC archives: writing, normalising monolithic gzip files, reading by offset index.

:func:`write_archives` writes each task's records as one gzip stream over the whole file. :func:`normalise` inflates such a
file once, from its start to its end, rewrites every record as a gzip member of its own and writes a sidecar index
``<file>.idx`` with a line ``offset length record-id`` per record. :func:`read_archives` seeks to each indexed member,
inflates it alone, parses the record and verifies the payload digest. All three hold one record at a time.

Null html is an empty payload. Of pages with equal payloads of at least ``min_bytes`` bytes, the largest page_id is the
response and the others are revisits that refer to it; rows that repeat the largest page_id are responses too. A null
page_id is smaller than any other. Files are written under a temporary name and renamed.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.work import cut, join_groups, new_path, shuffle_partitions

CHUNK, FILE_BYTES = 1 << 20, 1 << 28
URN = "<urn:page:{}>"
#: Records carry no clock: a rewritten file has the same bytes.
DATE = "2000-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", URN.format("none" if page_id is None else page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", URN.format(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, piece by piece."""
    state = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if state.eof:
                state = zlib.decompressobj(31)
            if out := state.decompress(chunk, CHUNK):
                yield out
            chunk = state.unconsumed_tail or state.unused_data
            if state.eof and not state.unused_data:
                break
    while not state.eof and (out := state.decompress(state.unconsumed_tail, CHUNK)):
        yield out


def records(content: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with the blank lines that end them, from a stream of bytes."""
    held = bytearray()
    need = 0  # bytes of the record at the start of held, 0 while its header is not whole
    for piece in content:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(header(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(("WARC/", "HTTP/")):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and refers_to of a record; a payload that is there is verified."""
    top = raw.index(b"\r\n\r\n")
    warc = header(raw[:top])
    block = raw[top + 4 : top + 4 + int(warc["content-length"])]
    split = block.index(b"\r\n\r\n")
    size = int(header(block[:split])["content-length"])
    told = warc["warc-payload-digest"].removeprefix("sha1:")
    kind = warc["warc-type"]
    if kind == "response":
        payload = block[split + 4 :]
        if len(payload) != size or digest(payload) != told:
            raise ValueError(f"payload of {warc['warc-record-id']} is damaged")
    number = lambda urn: None if urn is None or urn == URN.format("none") else int(urn[len("<urn:page:") : -1])
    return number(warc["warc-record-id"]), size, told, kind, number(warc.get("warc-refers-to"))


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses)."""
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("mark", F.sha1("payload"))
    shared = rows.where(F.length("payload") >= min_bytes).groupBy("mark").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
    shared = cut(shared.where("pages > 1").select(F.col("mark").alias("of"), "first", F.col("pages").alias("rows")), "shared")
    joined = join_groups(rows, F.col("mark"), F.col("page_id"), shared.drop("rows"), "of", 2 * shared.count(), shared.select("of", "rows"))
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write monolithic archives to ``folder``; one row (path) per file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        rows = (row for part in parts for row in zip(*(part.column(i) for i in range(4)), strict=True))
        first = next(rows, None)
        while first is not None:
            path, size = f"{base}/whole-{uuid.uuid4().hex}.warc.gz", 0
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            with store.open_output_stream(path + ".part", compression=None) as out:
                while first is not None and size < FILE_BYTES:
                    raw = record(*(x.as_py() for x in first))
                    size += len(raw)
                    out.write(packer.compress(raw))
                    first = next(rows, None)
                out.write(packer.flush())
            store.move(path + ".part", path)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return cut(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string"), "archives")


def _listed(files: DataFrame) -> DataFrame:
    """A file per task, as far as tasks go."""
    return files.repartition(max(1, 4 * shuffle_partitions(files.sparkSession)), "path")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives with a member per record and a sidecar index; one row (path) per new file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for part in parts:
            for source in part.column(0).to_pylist():
                path = f"{base}/members-{uuid.uuid4().hex}.warc.gz"
                index, at = io.StringIO(), 0
                with store.open_input_stream(source, compression=None) as file, store.open_output_stream(path + ".part", compression=None) as out:
                    for raw in records(inflated(iter(lambda: file.read(CHUNK), b""))):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        index.write(f"{at} {len(member)} {header(raw[: raw.index(b'\r\n\r\n')])['warc-record-id']}\n")
                        at += len(member)
                with store.open_output_stream(path + ".idx", compression=None) as out:
                    out.write(index.getvalue().encode())
                store.move(path + ".part", path)
                yield pa.RecordBatch.from_pydict({"path": [path]})

    return cut(_listed(files).mapInArrow(run, "path string"), "normalised")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of normalised archives, read member by member through the index."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for part in parts:
            for path in part.column(0).to_pylist():
                with store.open_input_stream(path + ".idx", compression=None) as file:
                    index = [x.split(" ", 2) for x in file.read().decode().splitlines()]
                with store.open_input_file(path) as file:
                    for at in range(0, len(index), 1000):
                        rows = []
                        for offset, length, _ in index[at : at + 1000]:
                            rows.append(parse(zlib.decompress(file.read_at(int(length), int(offset)), 31)))
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _listed(files).mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in a new folder below the shared one and read the normalised archives back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(with_references(pages, min_bytes), folder), folder), folder)
