"""WARC archives: a writer with identical-payload revisits and a salvaging reader.

The reader checks every record. After a failed check it searches for the next gzip
member or version line that starts a valid record, goes on from there, and
reports the bytes between as a quarantined gap. Members may hold any number of
records: version lines are also searched inside their decoded bytes, and what a
damaged member yields before its fault is kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Workspace, shared_dir, small_batches, stretches, table

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Where a record may start in an archive: a gzip member or a version line.
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes taken at once, bytes read and decoded at once, and the longest header that is looked for.
PART, BLOCK, HEADER = 1 << 14, 1 << 20, 1 << 20
URN = "urn:page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id, url: str | None, payload: bytes, refers_to=None, stamp: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response record, or, given ``refers_to``, a revisit without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", stamp),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    """A record that passed its checks. ``offset`` is where its member, or it itself if plain,
    starts in the archive; ``inner`` is where it starts in the member's decoded bytes."""

    offset: int
    inner: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        """The length of the full payload: of a revisit, what its HTTP header says."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", head) if self.fields.get("warc-type") == "revisit" else None
        return int(said[1]) if said else len(payload)


@dataclass(frozen=True)
class Gap:
    """Quarantined bytes: of the archive from ``offset``, or, inside a sound member, of its decoded bytes from
    ``inner``. The gap of a damaged member covers its compressed bytes; ``inner`` is how far its records were recovered."""

    offset: int
    inner: int
    size: int
    reason: str


class Archive:
    """Random access to a file or to bytes; of a file, BLOCK bytes are held."""

    def __init__(self, source):
        self.source, self.start, self.block = source, 0, source if isinstance(source, bytes) else b""
        self.length = len(source) if isinstance(source, bytes) else source.size()

    def size(self) -> int:
        return self.length

    def read_at(self, n: int, at: int) -> bytes:
        n = min(n, self.length - at)
        if at < self.start or at + n > self.start + len(self.block):
            self.start, self.block = at, self.source.read_at(max(n, min(BLOCK, self.length - at)), at)
        return self.block[at - self.start : at - self.start + n]


class _Plain:
    """The bytes of an archive as they are, from some place on; ``left`` is how many there are."""

    def __init__(self, file, at: int):
        self.file, self.at, self.left = file, at, file.size() - at

    def more(self) -> bytes:
        got = self.file.read_at(PART, self.at)
        self.at += len(got)
        return got


class _Decoded:
    """The decoded bytes of the gzip member that starts at some place.

    After its last bytes, ``end`` is where the member ends if it is sound, or else ``fault`` says what is wrong.
    """

    left = None

    def __init__(self, file, at: int):
        self.file, self.at, self.end, self.fault = file, at, None, None
        self.inflate, self.raw = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        while self.end is None and self.fault is None:
            if not self.raw:
                self.raw = self.file.read_at(PART, self.at)
                self.at += len(self.raw)
            last, before = not self.raw, self.inflate.copy()
            try:
                got = self.inflate.decompress(self.raw, BLOCK)
                self.raw = self.inflate.unconsumed_tail
            except zlib.error as e:
                got, self.fault = _up_to_fault(before, self.raw), f"gzip: {e}"
            if self.inflate.eof:
                self.end = self.at - len(self.inflate.unused_data)
            elif last and not got:
                self.fault = self.fault or "gzip: cut short"
            if got:
                return got
        return b""


def _up_to_fault(inflate, raw: bytes) -> bytes:
    """What bytes decode to before their fault; a call that fails returns nothing, so each has one byte."""
    out = []
    try:
        for i in range(len(raw)):
            out.append(inflate.decompress(raw[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _parse(source, buffer: bytearray, at: int) -> tuple[dict, bytes, int]:
    """The record at ``at`` of the buffer, which is filled from ``source`` as far as needed: (fields, block, end).

    ValueError on a failed check.
    """

    def need(n: int) -> bool:
        while len(buffer) < n and (got := source.more()):
            buffer.extend(got)
        return len(buffer) >= n

    need(at + 10)
    if not VERSION.match(buffer, at):
        raise ValueError("no version line")
    while (stop := buffer.find(b"\r\n\r\n", at)) < 0:
        if len(buffer) - at > HEADER or not need(len(buffer) + 1):
            raise ValueError("header without end")
    fields = {}
    for line in bytes(buffer[at:stop]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdecimal()):
        raise ValueError("no content length")
    start, end = stop + 4, stop + 4 + int(size)
    if source.left is not None and end + 4 > source.left:
        raise ValueError("block longer than the archive")
    if not need(end + 4) or buffer[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block without end")
    block = bytes(buffer[start:end])
    if (want := fields.get("warc-block-digest", "")).startswith("sha1:") and want != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    return fields, block, end + 4


def _inside(file, offset: int) -> Iterator[Record | Gap | tuple[int | None, int, str | None]]:
    """Records and gaps of the member at ``offset``, and at last (its end if it is sound, how many decoded
    bytes were recovered, its fault). A gap comes only before a record or at the end of a sound member.

    Only the decoded bytes of the record at hand are held, or those on which a check failed.
    """
    source, buffer = _Decoded(file, offset), bytearray()
    base, at, lost, why = 0, 0, None, ""  # ``base`` decoded bytes came before the buffer
    while True:
        if at >= len(buffer):
            if not (got := source.more()):
                break
            buffer.extend(got)
        try:
            fields, block, end = _parse(source, buffer, at)
        except ValueError as failed:
            if lost is None:
                lost, why = base + at, str(failed)
            while not (m := VERSION.search(buffer, at + 1)):
                # A version line may have begun in the last bytes; what is before them goes.
                past = max(at, len(buffer) - 10)
                base, at = base + past, 0
                del buffer[:past]
                if not (got := source.more()):
                    at = len(buffer)
                    break
                buffer.extend(got)
            else:
                at = m.start()
            continue
        if lost is not None:
            yield Gap(offset, lost, base + at - lost, why)
            lost = None
        yield Record(offset, base + at, fields, block)
        base, at = base + end, 0
        del buffer[:end]
    recovered = base + at if lost is None else lost
    if source.end is not None and lost is not None:
        yield Gap(offset, lost, base + at - lost, why)
    yield source.end, recovered, source.fault


def salvage(file: Archive) -> Iterator[Record | Gap]:
    """Every valid record of an archive and the gaps between them, in order.

    Memory holds one record at a time and, after a failed check, the bytes it failed on.
    """
    size, at, lost = file.size(), 0, None  # ``lost``: offset, inner and reason of a gap that is still open

    def close(to: int) -> Iterator[Gap]:
        if lost and to > lost[0]:
            yield Gap(lost[0], lost[1], to - lost[0], lost[2])

    while at < size:
        if file.read_at(3, at) == MEMBER:
            for item in _inside(file, at):
                if isinstance(item, tuple):
                    end, inner, fault = item
                    break
                yield from close(at)
                lost = None
                yield item
            if end is None:
                lost = lost or (at, inner, fault)
                at = _candidate(file, at + 1)
            else:
                yield from close(at)
                lost, at = None, end
            continue
        try:
            fields, block, used = _parse(_Plain(file, at), bytearray(), 0)
        except ValueError as failed:
            lost = lost or (at, 0, str(failed))
            at = _candidate(file, at + 1)
            continue
        yield from close(at)
        lost = None
        yield Record(at, 0, fields, block)
        at += used
    yield from close(size)


def _candidate(file, at: int) -> int:
    """The next place from ``at`` on where a record may start, or the archive's end."""
    size = file.size()
    while at < size:
        part = file.read_at(PART + 9, at)
        if m := START.search(part):
            return at + m.start()
        at += PART
    return size


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, target_mb: float = 32.0) -> DataFrame:
    """Write a record per row of (page_id, url, html) into gzip-per-record archives under ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes``, the one of
    smallest page_id is a response and the others revisit it. An archive is closed
    once its records have ``target_mb`` before compression. Returns the manifest
    ``file, records, bytes``, itself written beside the archives: archives are named
    by a random suffix for each attempt, so those of lost or repeated tasks are in no
    manifest and are not read. ``path`` must be one that every executor reaches.

    Payloads are hashed where they are read; only digests and ids are grouped. Fewer
    than ``HOT_KEYS`` digests can each have over 1/HOT_KEYS of all pages; those few are
    broadcast, so a payload that a third of all pages share makes no large task. html
    moves once, by page_id.

    Defined cases: a null html is an empty payload; a null url an empty URI. Rows
    of the same smallest page_id are all responses; a row without a page_id is a
    response that nothing refers to. A repeated row is a record of its own. A very long html is held
    once as text and once as a record. Further columns are ignored, whatever their names. No rows: no
    archives and an empty manifest.
    """
    small_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    named = base.where(F.col("page_id").isNotNull())
    space = Workspace(pages.sparkSession, "warc-index")
    small = space.cut(
        named.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= min_revisit_bytes).drop("n"),
        "digests",
    )
    first = space.cut(
        small.groupBy("sha")
        .agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("refers_to < last")
        .drop("last"),
        "payloads",
        space.rows["digests"],
        64,
    )
    limit = space.rows["digests"] / HOT_KEYS
    hot = F.broadcast(first.where(F.col("n") > limit).select("sha", "refers_to"))
    rare = first.where(F.col("n") <= limit).select("sha", "refers_to")
    revisits = (
        small.join(hot, "sha")
        .unionByName(small.join(hot, "sha", "left_anti").join(rare, "sha"))
        .where("page_id <> refers_to")
        .select("page_id", "sha", "refers_to")
        .distinct()
    )
    joined = named.withColumn("sha", F.sha1("html")).join(revisits, ["page_id", "sha"], "left").drop("sha")
    rows = joined.unionByName(base.where(F.col("page_id").isNull()).withColumn("refers_to", F.lit(None).cast("long")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        out, name, count, plain, size, done = None, "", 0, 0, 0, []
        for batch in batches:
            for a, b in stretches(batch.column("html")):
                part = batch.slice(a, b - a)
                for page_id, url, html, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, count, plain, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, 0
                    whole = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers)
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = gz.compress(whole) + gz.flush()
                    out.write(data)
                    count, plain, size = count + 1, plain + len(whole), size + len(data)
                    if plain >= target_mb * 1e6:
                        out.close()
                        done.append((name, count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    manifest = space.cut(rows.mapInArrow(write, "file string, records long, bytes long"), "manifest")
    space.drop("digests", "payloads")
    return manifest


SALVAGED = (
    "file string, offset long, inner long, gap_bytes long, gap_reason string, warc_type string, record_id string, uri string, "
    "payload_digest string, payload_bytes long, refers_to string"
)
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
#: Records and bytes of payload in one Arrow batch of the reader.
ROWS, ROW_BYTES = 500, 4_000_000


def read_warc(manifest: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """A row for every record that passes its checks and one for every gap, which has a ``gap_reason``.

    ``payload_digest`` (bare base32 SHA-1) and ``payload_bytes`` of a response are those of the payload
    read; of a revisit, those its headers give of the full payload. With ``payload`` the bytes come too.
    Where an archive yields another number of records than the manifest says, a row without a
    record but with that reason (and no bytes of gap) says so; a manifest without ``records`` makes no such claim.

    Defined cases: an archive that cannot be opened is a gap of its manifest bytes; an empty one has
    neither records nor gaps. A very long record is held as a whole. An empty manifest has no rows.
    """
    schema = SALVAGED + (", payload binary" if payload else "")
    columns = [c.split() for c in schema.split(", ")]
    claim = [c for c in ("records", "bytes") if c in manifest.columns]

    def rows_of(store, root: str, name: str, claims: dict) -> Iterator[tuple]:
        nothing = [None] * (7 if payload else 6)
        try:
            file = store.open_input_file(f"{root}/{name}")
        except OSError as e:
            yield (name, 0, 0, claims.get("bytes") or 0, f"cannot be opened: {type(e).__name__}", *nothing)
            return
        records = 0
        with file:
            for x in salvage(Archive(file)):
                if isinstance(x, Gap):
                    yield (name, x.offset, x.inner, x.size, x.reason, *nothing)
                    continue
                records += 1
                h, body = x.fields, x.payload
                said = h.get("warc-payload-digest", "")
                sha = said.removeprefix("sha1:") if h.get("warc-type") == "revisit" else digest(body)
                found = (name, x.offset, x.inner, 0, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), sha, x.payload_bytes, h.get("warc-refers-to"))
                yield (*found, body) if payload else found
        if "records" in claims and records != claims["records"]:
            yield (name, 0, 0, 0, f"{records} records of {claims['records']} in the manifest", *nothing)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[kind]) for i, (_, kind) in enumerate(columns)], [n for n, _ in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for one in batch.to_pylist():
                rows, size = [], 0
                for row in rows_of(store, root, one.pop("file"), one):
                    rows.append(row)
                    size += len(row[-1] or b"") if payload else 0
                    if len(rows) >= ROWS or size >= ROW_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("file", *claim).repartition(max(1, manifest.count()), "file").mapInArrow(read, schema)


def gaps(salvaged: DataFrame) -> DataFrame:
    """The gap log: ``file, offset, inner, gap_bytes, gap_reason`` of what was quarantined or is missing."""
    return salvaged.where("gap_reason IS NOT NULL").select("file", "offset", "inner", "gap_bytes", "gap_reason")


def page_rows(salvaged: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records."""
    number = lambda c: F.nullif(F.regexp_extract(c, rf"^<{URN}(-?\d*)>$", 1), F.lit("")).cast("long")
    return salvaged.where("gap_reason IS NULL").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to")
    )


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write pages as archives under ``path`` and give the page rows read back.

    What was read is kept beside the archives, gaps included; a gap or a missing
    record is an error, since the archives were written just now.
    """
    salvaged = Workspace(pages.sparkSession, "warc-read").cut(read_warc(write_warc(pages, path), path, payload=False), "salvaged")
    if lost := gaps(salvaged).first():
        raise RuntimeError(f"archives under {path} do not read back whole: {lost.asDict()}")
    return page_rows(salvaged)


def op7_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, lower(sha1(html)) AS hex FROM p),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda x:
    '0000000100100011010001010110011110001001101010111100110111101111'[4 * (strpos('0123456789abcdef', x) - 1) + 1 : 4 * strpos('0123456789abcdef', x)]), '') AS b
  FROM h
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]), '') AS payload_digest
  FROM bits
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM f
"""
