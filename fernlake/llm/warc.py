"""Web archives: a converter from legacy ARC files to WARC files, and readers of both.

ARC files begin with a version block ("filedesc://") whose first line holds the
version, and whose second the names of the header fields.  A version 1 header
has five fields (URL, IP, date, type, length), a version 2 header ten (result
code, checksum, location, offset and file name besides); a record is its header
line, the declared number of bytes, and a line feed.  The converter parses the
header by its version and takes exactly the declared bytes, then makes a WARC
record: its identifier is a name-based UUID of URL, date and digest, its date
the 14 digits as ISO 8601, its type response or revisit, its digests SHA-1 in
base 32.

A null payload is empty.  Among records of equal payloads of at least
`revisit_from` bytes the one with the largest id is the response and the others
revisit it; smaller payloads are all responses.  Of rows that repeat the largest
id one is the response (that of the last place in the ARC files), and the others
revisit it.  A null id counts as the least.  A null URL is written as "urn:none".
An empty table gives no archive and no row.  A payload of any length is one
record, held in memory as a whole.  Other columns are not read.

Bodies are never dealt out: a task names the distinct digests of its ARC file,
Spark finds the newest record of each digest that stands more than once, and the
task that converts a file gets these beside it.  So a payload that a third of
all pages share is one row a file.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.common import fresh_path, groups_by_size, materialise, read_file, rows_of, write_file

#: Header fields by version (fixed values of the format).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
FILE_BYTES = 32 << 20
#: Files are dealt out to so many tasks at most; more share one, a file at a time.
MOST_TASKS = 100_000
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:fernlake:warc")
#: Archive date of rows that carry none.
NO_DATE = "20000101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe(field: str) -> str:
    """A header field: no white space or control characters, never empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", field) or "-"


# --- ARC ---------------------------------------------------------------------


def arc_file(name: str, version: int, records: list[tuple[str, str, str, str, bytes]]) -> list[bytes]:
    """The records of an ARC file, its version block first, from (url, ip, date, type, body)."""
    about = f"{version} 0 fernlake\n{' '.join(FIELDS[version])}\n".encode()
    parts = [arc_header(version, f"filedesc://{name}", "0.0.0.0", NO_DATE, "text/plain", about, 0, name) + about + b"\n"]
    at = len(parts[0])
    for url, ip, date, kind, body in records:
        head = arc_header(version, url, ip, date, kind, body, at, name)
        parts.append(head + body + b"\n")
        at += len(parts[-1])
    return parts


def arc_header(version: int, url: str, ip: str, date: str, kind: str, body: bytes, offset: int, name: str) -> bytes:
    fields = [safe(url), ip, date, safe(kind)]
    if version == 2:
        fields += ["200", sha1_base32(body), "-", str(offset), name]
    return (" ".join([*fields, str(len(body))]) + "\n").encode()


def parse_arc(raw: bytes) -> Iterator[dict]:
    """Records after the version block: the header's fields by name, and body.

    The header is taken apart from its right end, since old URLs may hold spaces.
    """
    at, version = 0, 0
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):  # some writers put more line feeds between records
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"a header without end at byte {at}")
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r")
        if not version:
            length = int(line.rpartition(" ")[2])
            block = raw[end + 1 : end + 1 + length]
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            at = end + 1 + length
            continue
        values = line.rsplit(" ", len(FIELDS[version]) - 1)
        if len(values) != len(FIELDS[version]):
            raise ValueError(f"a header of {len(values)} fields at byte {at}")
        record = dict(zip(FIELDS[version], values, strict=True))
        length = int(record["Archive-length"])
        body = raw[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"a record cut short at byte {at}")
        yield record | {"body": body}
        at = end + 1 + length


# --- WARC --------------------------------------------------------------------


def iso_date(arc_date: str) -> str:
    """An ARC date of 14 digits, or of 12 or 8 in old files, as ISO 8601."""
    digits = arc_date.ljust(14, "0")
    return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {digest}')}>"


def warc_record(kind: str, url: str, date: str, identifier: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", date), ("WARC-Target-URI", url), *headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def http_block(kind: str, status: str, length: int) -> bytes:
    return f"HTTP/1.1 {status} OK\r\nContent-Type: {kind}\r\nContent-Length: {length}\r\n\r\n".encode()


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(raw: bytes) -> Iterator[bytes]:
    """Each gzip member of a file, without copying the rest of it again and again."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        reader, parts, step = zlib.decompressobj(31), [], 1 << 16
        while not reader.eof:
            if at >= len(raw):
                raise ValueError("a gzip member is cut short")
            parts.append(reader.decompress(view[at : at + step]))
            at += min(step, len(raw) - at)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


# --- DataFrames --------------------------------------------------------------

RECORD = "id long, url string, date string, kind string, status string, body binary, digest string"
#: One row per file and digest: how many records, and of the newest its id (nulls least), place, URL and date.
DIGESTS = "file string, digest string, n long, id long, place string, url string, date string"
NO_ID = -(2**63)


def write_arc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 2, date: str | None = None) -> DataFrame:
    """ARC files of a table, a gzip member per record; a table of their names.  The id goes into the URL's fragment."""
    to = fresh_path(pages.sparkSession, "arc")
    schema = pa.schema([("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, group in enumerate(groups_by_size(rows_of(batches, "id", "url", "date", "text"), lambda r: len(r[3] or b"") + 256, FILE_BYTES)):
            name = f"part-{part:06d}-{seq:04d}.arc.gz"
            records = [(f"{u or 'urn:none'}#fernlake-id={'' if i is None else i}", "0.0.0.0", d or NO_DATE, "text/html", t or b"") for i, u, d, t in group]
            write_file(f"{to}/{name}", [gzip_member(r) for r in arc_file(name, version, records)])
            yield pa.record_batch([[f"{to}/{name}"]], schema=schema)

    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), (F.col(date).cast("string") if date else F.lit(None).cast("string")).alias("date"), F.col(payload).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, "file string"), "arc-files")


def dealt(files: DataFrame) -> DataFrame:
    """A table of file names, one file to a task as far as there are partitions."""
    return files.repartition(max(1, min(files.count(), MOST_TASKS)))


def arc_records(name: str) -> Iterator[tuple]:
    for r in parse_arc(b"".join(members(read_file(name)))):
        url, _, tag = r["URL"].rpartition("#fernlake-id=")
        yield (int(tag) if tag.lstrip("-").isdigit() and url else None, url or r["URL"], r["Archive-date"], r["Content-type"], r.get("Result-code", "200"), r["body"], sha1_base32(r["body"]))


def read_arc(files: DataFrame) -> DataFrame:
    """Records of ARC files: id, url, date, kind, status, body and digest of the body."""
    schema = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in ("url", "date", "kind", "status")), ("body", pa.binary()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,) in rows_of(batches, "file"):
            for group in groups_by_size(arc_records(name), lambda r: len(r[5]) + 256, 4 << 20):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*group, strict=True), schema, strict=True)], schema=schema)

    return dealt(files).mapInArrow(run, RECORD)


def place_of(name: str, n: int) -> str:
    """A record's place: the file's name without its folder, and which record of it."""
    return f"{name.rpartition('/')[2]}/{n:09d}"


def digests(files: DataFrame, revisit_from: int) -> DataFrame:
    """Of each file its distinct digests of payloads that may be revisited; a null digest stands for the file itself."""
    schema = pa.schema([("file", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("id", pa.int64()), *((c, pa.string()) for c in ("place", "url", "date"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,) in rows_of(batches, "file"):
            counts: dict[str, int] = {}
            newest: dict[str, tuple] = {}
            for n, (i, url, date, _, _, body, digest) in enumerate(arc_records(name)):
                if len(body) >= revisit_from:
                    counts[digest] = counts.get(digest, 0) + 1
                    newest[digest] = max(newest.get(digest, (NO_ID, "")), (NO_ID if i is None else i, place_of(name, n), url, date))
            rows = [(name, None, 0, None, None, None, None), *((name, d, n, *newest[d]) for d, n in counts.items())]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return dealt(files).mapInArrow(run, DIGESTS)


def convert(files: DataFrame, revisit_from: int = 0) -> DataFrame:
    """WARC files of ARC files, one of each, a gzip member per record; a table of their names."""
    to = fresh_path(files.sparkSession, "warc")
    found = materialise(digests(files, revisit_from), "digests")
    newest = found.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("n"), F.max(F.struct("id", "place", "url", "date")).alias("newest"))
    newest = materialise(newest.where("n > 1").select("digest", "newest.id", "newest.place", "newest.url", "newest.date"), "newest")  # whether it may be broadcast is for its true size to say
    verdicts = found.where("digest is not null").select("file", "digest").join(newest, "digest").select("file", "digest", "id", "place", "url", "date")
    verdicts = verdicts.union(found.where("digest is null").select("file", "digest", "id", "place", "url", "date"))
    schema = pa.schema([("file", pa.string())])

    def one(place, i, url, date, kind, status, body, digest, other) -> bytes:
        day, about = iso_date(date), [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Record-Key", "" if i is None else str(i))]
        identifier, http = record_id(f"{url} {place}", day, digest), http_block(kind, status, len(body))
        if other is None or other[1] == place:
            return warc_record("response", url, day, identifier, http + body, [*about, ("Content-Type", "application/http; msgtype=response")])
        to_id, to_place, to_url, to_date = other
        to_day, key = iso_date(to_date), "" if to_id == NO_ID else str(to_id)
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"{to_url} {to_place}", to_day, digest)), ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", to_day), ("X-Refers-To-Key", key), ("X-Payload-Length", str(len(body)))]
        return warc_record("revisit", url, day, identifier, http, [*about, ("Content-Type", "application/http; msgtype=response")])

    def run(key, group):
        name = key[0].as_py()
        others = {r["digest"]: (r["id"], r["place"], r["url"], r["date"]) for r in group.to_pylist() if r["digest"] is not None}
        target = f"{to}/{name.rpartition('/')[2].removesuffix('.arc.gz')}.warc.gz"
        write_file(target, (gzip_member(one(place_of(name, n), *r, others.get(r[6]))) for n, r in enumerate(arc_records(name))))
        return pa.table([[target]], schema=schema)

    # A file's rows are its distinct digests with company, fewer than its records.  They are small, the files
    # aren't: so the rows are dealt out over a number of tasks that is not merged.
    tasks = max(1, min(files.count(), MOST_TASKS))
    return materialise(verdicts.repartition(tasks, "file").groupBy("file").applyInArrow(run, "file string"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files: id, url, warc_date, record_id, record_type, payload_bytes, payload_digest, refers_to, refers_to_id, payload.

    A revisit has no payload of its own: its length and digest are those of the full payload.
    """
    schema = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in ("url", "warc_date", "record_id", "record_type")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload", pa.binary())])

    def rows(name: str) -> Iterator[tuple]:
        for member in members(read_file(name)):
            head, block = parse_warc(member)
            payload = block.partition(b"\r\n\r\n")[2]
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            revisit = head["warc-type"] == "revisit"
            if head["warc-block-digest"] != f"sha1:{sha1_base32(block)}" or not revisit and sha1_base32(payload) != digest:
                raise ValueError(f"a digest doesn't fit in {name}")
            key, other = head["x-record-key"], head.get("x-refers-to-key")
            yield (int(key) if key else None, head["warc-target-uri"], head["warc-date"], head["warc-record-id"], head["warc-type"], int(head["x-payload-length"]) if revisit else len(payload), digest, int(other) if other else None, head.get("warc-refers-to"), None if revisit else payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,) in rows_of(batches, "file"):
            for group in groups_by_size(rows(name), lambda r: len(r[9] or b"") + 512, 4 << 20):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*group, strict=True), schema, strict=True)], schema=schema)

    return dealt(files).mapInArrow(run, "id long, url string, warc_date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, payload binary")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 2, revisit_from: int = 0) -> DataFrame:
    """Write a table as ARC, convert it to WARC, and read the WARC files back."""
    return read_warc(convert(write_arc(pages, key, url, payload, version), revisit_from))
