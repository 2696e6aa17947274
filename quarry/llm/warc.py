"""WARC archives: a writer with revisit records, and a salvage reader.

The writer gives each record a gzip member of its own, as crawlers do. The reader walks an archive
from valid piece to valid piece, be it a gzip member or a plain record at a version line. Where a
check fails (a broken member, a malformed header, a wrong length, ending or digest) it searches for
the next place at which everything holds, recovers the records from there on, and logs the bytes
between as a quarantined gap with the reason. Members are inflated record by record, so those before
a damage are recovered, and memory holds a record and no whole member. The search is linear.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, small_batches, spread_join, staged, task_files

#: Archives are closed at this size; a task of the reader has one archive at a time.
ARCHIVE_BYTES = 32 << 20
#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 100
#: A table of repeated payloads of at most this many rows (of about 100 bytes) is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 50_000
#: Bytes of an archive that are inflated at once.
PIECE_BYTES = 1 << 16
_GZIP = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")  # damage may have taken the end of the line before
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_VERSION_LINE = re.compile(rb"\nWARC/\d\.\d\r\n")
_MANDATORY = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, n_records long, n_bytes long"
RECORDS = "file string, start long, end long, gap string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def record_bytes(kind: str, page_id, url: str | None, payload: bytes, digest: str, length: int, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and says length and digest of the payload it stands for."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of (page_id, url, html); returns the manifest of the archives.

    A null html is an empty payload, a null url is left out, a null page_id is empty in the record.
    Of rows whose payloads are equal and long enough, those with the smallest page_id are responses
    (rows repeated with that page_id too), the others revisits of it. Tasks that run again write
    files of another name; the manifest says which count. Other columns are left aside.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    long = rows.filter(F.octet_length("html") >= REVISIT_BYTES)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = staged(firsts, "repeated-payloads")
    if firsts.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(firsts.drop("n")), "digest", "left")
    else:
        joined = spread_join(rows, firsts, "digest", "n", rows.count(), F.col("page_id"), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = joined.select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"), F.when(~other | other.isNull(), F.col("html")).alias("html"), "digest", F.when(other, F.col("first")).alias("refers_to"))

    def write(batches):
        store, top = task_files(folder)
        store.create_dir(top, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["page_id"].tolist()]
            refers = [None if pd.isna(x) else int(x) for x in batch["refers_to"].tolist()]
            for page_id, url, n, html, digest, to in zip(ids, batch["url"], batch["n_bytes"], batch["html"], batch["digest"], refers, strict=True):
                if out is None:
                    name, records, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                kind = "response" if to is None else "revisit"
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(kind, page_id, url, (html or "").encode() if to is None else b"", digest, n, to)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pd.DataFrame(done, columns=["file", "n_records", "n_bytes"])

    with small_batches(spark):
        marked.mapInPandas(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class Broken(ValueError):
    """Why a piece of an archive does not hold."""


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    payload: bytes


def _differs(told: str, content: bytes) -> bool:
    """Whether a digest "method:value", in hexadecimal or base32, is not that of the content. Unknown methods say nothing."""
    method, _, value = told.partition(":")
    method, value = method.strip().lower().replace("-", ""), value.strip()
    if method not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return False
    own = hashlib.new(method, content).digest()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


class Short(Broken):
    """What is there may be the beginning of a whole record."""


class _Headers:
    """Where headers end in a buffer. One end is looked up once, however many version lines stand before it."""

    def __init__(self, buf, stop: int):
        self.buf, self.stop, self.end, self.told, self.line = buf, stop, -1, -1, -1

    def end_after(self, at: int) -> int:
        """The first end of a header from ``at`` on, or the end of the buffer. ``told``: the last place from which all the
        mandatory fields are still to come; ``line``: the last version line that begins a line before that end."""
        if self.end < at:
            found = self.buf.find(b"\r\n\r\n", at, self.stop)
            self.end = self.stop if found < 0 else found
            self.told = self.line = -1
            if found >= 0:
                wanted, upto = set(_MANDATORY), found
                while wanted and upto > at:
                    begin = max(self.buf.rfind(b"\n", at, upto) + 1, at)
                    wanted.discard(bytes(self.buf[begin:upto]).partition(b":")[0].strip().lower())
                    upto = begin - 1
                    self.told = -1 if wanted else begin
                for line in _VERSION_LINE.finditer(self.buf, at, found + 2):
                    self.line = line.start() + 1
        return self.end


def _plain(buf, start: int, stop: int, ends_of: _Headers | None = None) -> Record:
    """The record whose version line is at ``start``, if all of it holds."""
    version = _VERSION.match(buf, start, stop)
    if not version:
        raise Broken("no version line")
    known = ends_of or _Headers(buf, stop)
    ends = known.end_after(version.end() - 2)
    if ends == stop:
        raise Short("header without end")
    inner = _VERSION.search(buf, version.end(), ends + 2)
    # A value may end like a version line, but only a header of its own begins a line or has all the fields after it.
    if inner and (known.line > start or not start < known.told < inner.start()):
        raise Broken("header runs into another record")
    headers: dict[str, str] = {}
    for line in bytes(buf[version.end() : ends]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("malformed header")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no content length")
    at, end = ends + 4, ends + 4 + int(length)
    if end + 4 > stop:
        raise Short("truncated record")
    if bytes(buf[end : end + 4]) != b"\r\n\r\n":
        raise Broken("wrong content length")
    payload = bytes(buf[at:end])
    if _differs(headers.get("warc-block-digest", ""), payload):
        raise Broken("block digest differs")
    http = headers.get("content-type", "").lower().startswith("application/http")
    if headers.get("warc-type") != "revisit" and "warc-segment-number" not in headers and _differs(headers.get("warc-payload-digest", ""), payload.partition(b"\r\n\r\n")[2] if http else payload):
        raise Broken("payload digest differs")
    return Record(start, end + 4, headers, payload)


class _Member:
    """A gzip member at ``start``, inflated as far as its records ask for."""

    def __init__(self, buf, start: int, stop: int):
        self.buf, self.start, self.at, self.stop = buf, start, start, stop
        self.pull, self.window, self.begun = zlib.decompressobj(31), bytearray(), False
        #: Why the member is not whole, and why some of its content is no record.
        self.damage: str | None = None
        self.lost: str | None = None

    def _more(self) -> None:
        piece = bytes(self.buf[self.at : min(self.stop, self.at + PIECE_BYTES)])
        if not piece:
            self.damage = "truncated member"
            return
        before = self.pull.copy()
        try:
            self.window += self.pull.decompress(piece)
        except zlib.error:  # what comes before the damage: in ever smaller steps
            self.damage, self.pull, done = "broken member", before, 0
            for step in (4096, 256, 16, 1):
                while done < len(piece):
                    before = self.pull.copy()
                    try:
                        self.window += self.pull.decompress(piece[done : done + step])
                    except zlib.error:
                        self.pull = before
                        break
                    done += step
            self.at += done
            return
        self.at += len(piece)

    def _fill(self, least: int) -> bool:
        """Whether the window could be made longer, to ``least`` bytes if there are so many."""
        before = len(self.window)
        while len(self.window) < least and not self.pull.eof and self.damage is None:
            self._more()
        return len(self.window) > before

    def records(self) -> Iterator[Record]:
        """The whole records of the member, each with the bytes read so far as its range."""
        at, ends_of = 0, None
        while True:
            if at >= len(self.window):
                del self.window[:]
                at, ends_of = 0, None
                if not self._fill(PIECE_BYTES):
                    return
            if not self.begun and len(self.window) >= 5:
                self.begun = True
                if not self.window.startswith(b"WARC/"):
                    self.damage = self.damage or "member without version line"
                    return
            ends_of = ends_of or _Headers(self.window, len(self.window))
            try:
                one = _plain(self.window, at, len(self.window), ends_of)
            except Broken as e:
                if self._rest_may_hold_more() and (isinstance(e, Short) or len(self.window) - at < 16):
                    del self.window[:at]
                    at, ends_of = 0, None
                    if self._fill(2 * len(self.window) + PIECE_BYTES):
                        continue
                self.lost = self.lost or str(e)
                later = _VERSION.search(self.window, at + 1)
                if later:
                    at = later.start()
                elif self._rest_may_hold_more():
                    del self.window[:-12]  # a version line may go on in the next piece
                    at, ends_of = 0, None
                    self._fill(len(self.window) + PIECE_BYTES)
                else:
                    return
                continue
            yield Record(self.start, self.at - len(self.pull.unused_data), one.headers, one.payload)
            at = one.end

    def _rest_may_hold_more(self) -> bool:
        return not self.pull.eof and self.damage is None

    @property
    def end(self) -> int:
        return self.at - len(self.pull.unused_data)


def walk(buf) -> Iterator[Record | tuple[int, int, str]]:
    """The records of an archive and, as (start, end, reason), the gaps between them, in order of their bytes.

    Records of a member have the member's start, and as end how far it was read. A member of which only some
    records hold gives these, and a gap of its range; a damaged one gives the whole records before the damage,
    and a gap from its start to the next valid piece.
    """
    stop, at, gap, reason = len(buf), 0, None, ""
    ends_of = _Headers(buf, stop)
    while at < stop:
        why, some = None, False
        if bytes(buf[at : at + 3]) == _GZIP:
            member = _Member(buf, at, stop)
            for one in member.records():
                if gap is not None:
                    yield gap, at, reason
                    gap = None
                some = True
                yield one
            if member.damage or not some:
                why = member.damage or member.lost or "empty member"
            else:
                if member.lost:
                    yield at, member.end, member.lost
                at = member.end
        else:
            try:
                one = _plain(buf, at, stop, ends_of)
            except Broken as e:
                why = str(e)
            else:
                if gap is not None:
                    yield gap, at, reason
                    gap = None
                yield one
                at = one.end
        if why:
            if gap is None:
                gap, reason = at, why
            later = _START.search(buf, at + 1)
            at = later.start() if later else stop
    if gap is not None:
        yield gap, stop, reason


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def salvage(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of archives, given by ``path`` (as of Spark's ``binaryFile`` source, or any URI).

    A record has start and end of its bytes, its type and headers, and its payload if asked for; a gap
    has start, end and the reason in ``gap``, and nulls otherwise. Length and digest are those of the
    payload that was read; a revisit says those of the payload it stands for. An empty archive gives
    no rows; an archive named twice is read twice. Where a record is damaged, whole records inside its
    payload are recovered as records of their own. A task holds one archive: mapped where the folder is
    mounted, else read, so archives there should stay at the usual gigabyte.
    """
    n = max(1, archives.count())

    def read(batches):
        for batch in batches:
            for uri in batch["path"]:
                rows: list[tuple] = []
                size = 0
                for x in walk(_bytes(uri)):
                    if isinstance(x, Record):
                        h = x.headers
                        revisit = h.get("warc-type") == "revisit"
                        told = h.get("x-payload-length", "")
                        length = (int(told) if told.isdigit() else None) if revisit else len(x.payload)
                        digest = h.get("warc-payload-digest", "").partition(":")[2] or None if revisit else hashlib.sha256(x.payload).hexdigest()
                        rows.append((uri, x.start, x.end, None, h.get("warc-type"), _page(h.get("warc-record-id")), h.get("warc-target-uri"), length, digest, _page(h.get("warc-refers-to")), x.payload if keep_payload else None))
                        size += len(x.payload) if keep_payload else 200
                    else:
                        rows.append((uri, x[0], x[1], x[2], *[None] * 7))
                    if size > 8 << 20 or len(rows) >= 20_000:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    return archives.select("path").repartitionByRange(n, "path").mapInPandas(read, RECORDS)  # ranges of one archive each


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    return out.astype({k: "Int64" for k in ("page_id", "payload_bytes", "refers_to")})


def _bytes(uri: str):
    """The archive's bytes: mapped where its folder is mounted, else read."""
    store, path = task_files(uri)
    if store.type_name == "local":
        with open(path, "rb") as f:
            size = f.seek(0, 2)
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b""
    with store.open_input_file(path) as f:
        return f.read()


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every page through the archives."""
    folder = new_folder(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = salvage(manifest.select(F.concat(F.lit(f"{folder}/"), "file").alias("path")), keep_payload=False)
    found = staged(found.select("gap", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "salvaged")
    written = manifest.agg(F.sum("n_records")).first()[0] or 0
    recovered, gaps = found.agg(F.count_if(F.col("gap").isNull()), F.count("gap")).first()
    if written != recovered or gaps:
        raise RuntimeError(f"{written} records written, {recovered} recovered, {gaps} gaps")
    return found.filter("gap IS NULL").drop("gap")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
