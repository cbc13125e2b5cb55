"""WARC archives: a writer, and a salvage reader that goes on after damage.

The writer turns pages into gzipped WARC 1.1 records, one member each, in archives of bounded size
under the shared folder.  Of pages with equal payloads the one with the smallest page_id becomes the
response; the others become revisit records that hold its id and the HTTP header only.

The salvage reader checks every record (gzip trailer, version line, header block, content length,
end of record, block and payload digests).  After a failed check it looks for the next member or
version line from which a whole valid record can be read, in the inflated bytes of a member as long
as it inflates, goes on there, and reports the bytes in between as a quarantined gap.  It holds one
record at a time.  ``round_trip`` fails if an archive gives another number of records than were written.

Null html is the empty payload.  Pages without page_id keep null and are never the response of a
group that has ids.  Repeated page_ids are kept: one record for one row; a repeat of the response
with the same id and payload is a response too.  An empty table gives empty results.  Other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
STEP = 1 << 14  # compressed bytes that are inflated at once
WRITTEN = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
READ = pa.schema(
    [("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]
    + [("refers_to", pa.int64()), ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string())]
)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, a plain path, or Hadoop's ``file:/path``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record, not compressed.  A revisit's block ends with the HTTP header, which keeps the full length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(Exception):
    pass


class _Source:
    """Bytes from a position on, of a file or of a gzip member in it; ``save`` and ``load`` go back in them."""

    def __init__(self, f, at: int):
        self.f, self.at, self.buf, self.z = f, at, b"", None
        self.pos, self.base, self.chunk = at, at, b""  # next byte to take; the bytes of the file that are at hand
        self.tail, self.out, self.bad, self.mark = b"", 0, "", None
        self.raw = 0  # bytes of the file that were used up
        if self._take(3) == MAGIC:
            self.z = zlib.decompressobj(31)
        self.pos = at

    def save(self) -> tuple:
        return self.buf, self.z and self.z.copy(), self.pos, self.tail, self.out, self.bad, self.mark, self.raw

    def load(self, state: tuple) -> None:
        self.buf, z, self.pos, self.tail, self.out, self.bad, self.mark, self.raw = state
        self.z = z and z.copy()

    def _take(self, n: int) -> bytes:
        if not self.base <= self.pos < self.base + len(self.chunk):
            self.f.seek(self.pos)
            self.base, self.chunk = self.pos, self.f.read(CHUNK)
        data = self.chunk[self.pos - self.base : self.pos - self.base + n]
        self.pos += len(data)
        return data

    def more(self) -> bool:
        if self.z is None:
            data = self._take(CHUNK)
            self.buf += data
            return bool(data)
        if self.bad:
            raise Damaged(self.bad)
        if self.z.eof:
            return False
        piece = self.tail or self._take(STEP)
        self.mark = self.z.copy(), self.out, self.pos - len(piece), piece
        try:
            data = self.z.decompress(piece, 4 * STEP)
            self.tail = b"" if self.z.eof else self.z.unconsumed_tail
        except zlib.error as e:  # what comes before the damage counts
            data, self.bad = b"".join(d for _, d in self._slowly()), f"gzip: {e}"
        if not data and not self.bad and not piece:
            self.bad = "the gzip member has no end"
        if not data and self.bad:
            raise Damaged(self.bad)
        self.buf += data
        self.out += len(data)
        self.raw = self.pos - len(self.tail) - len(self.z.unused_data) - self.at
        return True

    def _slowly(self) -> Iterator[tuple[int, bytes]]:
        """The last step byte by byte: place in the file and what it inflates to."""
        z, _, place, piece = self.mark
        z = z.copy()
        try:
            for i in range(len(piece)):
                yield place + i, z.decompress(piece[i : i + 1])
        except zlib.error:
            return

    def place(self) -> int:
        """Where in the file the next byte comes from."""
        at = self.out - len(self.buf)
        if self.z is None or self.mark is None or not at:
            return self.at + (self.raw if self.z is None else 0)
        if not self.buf:
            return self.at + self.raw
        have = self.mark[1]
        for place, data in self._slowly():
            have += len(data)
            if have > at:
                return place
        return self.at + self.raw

    def need(self, n: int) -> bytes:
        parts, have = [self.buf], len(self.buf)
        while have < n:
            self.buf = b""
            if not self.more():
                raise Damaged("the record is cut off")
            parts.append(self.buf)
            have += len(self.buf)
        data = b"".join(parts)
        out, self.buf = data[:n], data[n:]
        if self.z is None:
            self.raw += n
        return out

    def until(self, mark: bytes) -> bytes:
        """Bytes up to a mark; a header may have any length."""
        seen = 0
        while (i := self.buf.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buf)
            if not self.more():
                raise Damaged("the record is cut off")
        return self.need(i + len(mark))


def _one(src: _Source) -> dict:
    while len(src.buf) < 10 and src.more():
        pass
    if not VERSION.match(src.buf):
        raise Damaged("no version line")
    head = src.until(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if sep:
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]+", fields.get("content-length", "")):
        raise Damaged("no content length")
    block = src.need(int(fields["content-length"]))
    if src.need(4) != b"\r\n\r\n":
        raise Damaged("no end of record")
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base32_sha1(block):
        raise Damaged("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    out = {"type": fields.get("warc-type"), "fields": fields, "payload": payload, "length": int(length[1]) if length else len(payload)}
    digest = fields.get("warc-payload-digest", "")
    if out["type"] == "response" and digest.startswith("sha1:") and digest[5:] != base32_sha1(payload):
        raise Damaged("payload digest")
    return out


def _starts(f, at: int, size: int) -> Iterator[int]:
    """Places from ``at`` on where a member or a version line may begin."""
    tail = b""
    while at < size:
        f.seek(at)
        data = f.read(CHUNK)
        if not data:
            return
        joined = tail + data
        base = at - len(tail)
        for m in re.finditer(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n", joined):
            if m.end() > len(tail):
                yield base + m.start()
        tail = joined[-12:]
        at += len(data)


def _next(src: _Source) -> tuple[int, dict] | None:
    """The next valid record after the next byte, and where it begins; None at the end of the bytes."""
    if not src.buf and not src.more():
        return None
    src.buf = src.buf[1:]
    while True:
        if (m := VERSION.search(src.buf)) is None:
            src.buf = src.buf[-10:]
            if not src.more():
                return None
            continue
        src.buf = src.buf[m.start() :]
        state = src.save()
        try:
            rec = _one(src)
        except Damaged:
            src.load(state)
            src.buf = src.buf[1:]
            continue
        after = src.save()
        src.load(state)
        at = src.place()
        src.load(after)
        return at, rec


def _member(src: _Source) -> Iterator[tuple[str, object]]:
    """Records and gaps of a gzip member, then ``("end", place)``, or ``("broken", (place, reason))``
    where it can't be inflated any further.  Its only record counts if the member's trailer is right."""
    only, n = None, 0
    while True:
        try:
            if not src.buf:
                if not src.more():
                    break
                continue
        except Damaged as e:
            yield "broken", (src.at if only else src.place(), str(e))
            return
        if only:
            yield "record", only
            only = None
        state = src.save()
        try:
            rec = _one(src)
        except Damaged as e:
            reason = f"{e} (after {n} good records of the member)" if n else str(e)
        else:
            n += 1
            if n == 1:
                only = rec
            else:
                yield "record", rec
            continue
        src.load(state)
        start = src.place()
        try:
            found = _next(src)
        except Damaged:
            yield "broken", (start, reason)
            return
        if found is None:
            yield "gap", (start, src.at + src.raw, reason)
            break
        yield "gap", (start, found[0], reason)
        yield "record", found[1]
        n += 1
    if only:
        yield "record", only
    yield "end", src.at + src.raw


def _begins(f, at: int) -> bool:
    """Whether a valid record can be read from here, or from within the member that begins here."""
    src = _Source(f, at)
    state = src.save()
    try:
        _one(src)
        return True
    except Damaged:
        if src.z is None:
            return False
    src.load(state)
    try:
        return _next(src) is not None
    except Damaged:
        return False


def salvage(f, size: int) -> Iterator[tuple[str, object]]:
    """``("record", dict)`` and ``("gap", (start, end, reason))`` of an archive, in order of place.

    A gap within a gzip member goes from the byte that the failed record begins in to the one that the
    next valid record begins in.
    """
    at = 0
    while at < size:
        src = _Source(f, at)
        if src.z is None:
            try:
                rec = _one(src)
                at += src.raw
                yield "record", rec
                continue
            except Damaged as e:
                start, reason = at, str(e)
        else:
            for kind, x in _member(src):
                if kind in ("record", "gap"):
                    yield kind, x
            if kind == "end":
                at = x
                continue
            start, reason = x
        nxt = next((p for p in _starts(f, max(at + 1, start), size) if _begins(f, p)), size)
        yield "gap", (start, nxt, reason)
        at = nxt


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as archives; a row ``path, records, bytes`` for each, written once.

    Payloads under ``least`` bytes are never revisits.  A task that runs again writes under new names,
    and only archives in the result are part of the output.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).withColumn("sha", F.sha1("payload"))
    first = (
        rows.where(F.length("payload") >= least)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .drop("n")
    )
    to = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))  # decided here: null for what is no revisit
    rows = rows.join(first, "sha", "left").select("sha", "page_id", "url", "payload", to.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        out, path, n, size = None, "", 0, 0
        done = []
        for batch in batches:
            for sha, page_id, url, payload, to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), to, to is not None)
                z = zlib.compressobj(5, zlib.DEFLATED, 31)
                data = z.compress(raw) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_pydict(dict(zip(WRITTEN.names, zip(*done) if done else ([], [], []))), WRITTEN)

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Records and gaps of the archives in column ``path`` (paths within the file system of ``folder``).
    With a column ``records``, an archive that gives another number of records fails the job.

    ``path, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` and, for a
    quarantined gap, ``gap_start, gap_end, reason`` with record_type ``gap``.
    """

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in READ.names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, READ.types)], schema=READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for path, want in zip(names, batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * len(names)):
                rows, held, n = [], 0, 0
                with fs.open_input_file(path) as f:
                    for kind, x in salvage(f, f.size()):
                        if kind == "gap":
                            rows.append((path, None, None, None, None, "gap", None, None, *x))
                            continue
                        n += 1
                        h = x["fields"]
                        to = re.fullmatch(r"<urn:page:(-?\d+)>", h.get("warc-refers-to", ""))
                        page_id = h.get("page-id")
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append((path, int(page_id) if page_id else None, h.get("warc-target-uri"), x["length"], digest, x["type"], int(to[1]) if to else None, x["payload"], None, None, None))
                        held += len(x["payload"])
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield frame(rows)
                            rows, held = [], 0
                if want is not None and n != want:
                    raise ValueError(f"{path}: {n} records read, {want} written")
                yield frame(rows)

    schema = "path string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, reason string"
    return paths.select("path", *(["records"] if "records" in paths.columns else [])).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of ``pages`` to a new folder of the shared one and read them back."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder, least, archive_bytes)
    n = max(1, min(written.count(), 10_000))
    return read_archives(written.select("path", "records").repartition(n), folder)


def op10_warc(spark, sf_dir) -> DataFrame:
    found = round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
