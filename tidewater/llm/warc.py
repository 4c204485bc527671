"""WARC archives: pages written as records, one gzip member each, and a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import written
from tidewater.sources.tables import shared_folder, spread

# fixed values of the format
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
_URN, _NULL = "<urn:x-record:id:", "<urn:x-record:null>"

_CHUNK, _WINDOW, _HEAD = 1 << 15, 1 << 22, 1 << 16
_FLUSH = 8 << 20


# --- writing -----------------------------------------------------------------------


def roles(pages: DataFrame, *, id_col: str = "page_id", least_bytes: int = 100) -> DataFrame:
    """pages (id, digest, bytes, ...) with `refers_to`: the smallest id among the rows with the same digest, where it is smaller than
    the row's own and the payload has `least_bytes` bytes or more; null for responses.

    Digests that several rows have are grouped, written and joined back: a table of one row for each of them, which is small
    enough to be broadcast by Spark or else lets adaptive execution split a digest that many rows have.
    """
    first = pages.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1 and first is not null").select(F.col("digest").alias("first_digest"), "first"), "payloads")
    joined = pages.join(first, F.col("digest") == F.col("first_digest"), "left")
    refers = F.when(F.coalesce(F.col("first") < F.col(id_col), F.col("first").isNotNull()), F.col("first"))
    return joined.withColumn("refers_to", refers).drop("first", "first_digest")


def write_archives(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, archive_bytes: int = 256 << 20, date: str | None = None, folder: str | None = None
) -> DataFrame:
    """Writes a record for each page to gzipped archives in the shared folder: (path, n_records, n_bytes) of the archives that count.

    Of equal payloads of at least `least_bytes` bytes, the record of the smallest id is the response, the others are revisits of
    it without a payload; all rows with that smallest id are responses. A task writes archives of about `archive_bytes` each, under names of its attempt's
    own, and the returned table, which Spark commits, names those that count: files of lost or repeated attempts are in no table.

    Null htmls are empty payloads; a null url gives a record without a target; rows with a null id are records with an id of
    their own kind, and revisit any other id. Repeated rows are records with the same record id. Texts of any length are one record. Extra columns are not read. An
    empty table gives none.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = spread(pages).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    ready = roles(rows, id_col="id", least_bytes=least_bytes).select(F.col("id").cast("string").alias("id"), F.col("refers_to").cast("string").alias("refers_to"), "url", "digest", "bytes", "payload")

    def write(batches):
        out, path, n, size, done = None, "", 0, 0, []
        fs, base = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    out, n, size = fs.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None), 0, 0
                    size += _put(out, _record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                size += _put(out, page_record(row, date))
                n += 1
                if size >= archive_bytes:
                    out.close()
                    out, done = None, [*done, (path, n, size)]
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_records", "n_bytes"])

    return written(ready.mapInArrow(write, "path string, n_records long, n_bytes long"), "archive-names")


def record_id(value: str | None) -> str:
    return _NULL if value is None else f"{_URN}{quote(value, safe='')}>"


def page_record(row: dict, date: str) -> bytes:
    """The record of a page (id, refers_to, url, digest, bytes, payload): an HTTP response, of a revisit only its head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    again = row["refers_to"] is not None
    fields = {"WARC-Type": "revisit" if again else "response", "WARC-Record-ID": record_id(row["id"]), "WARC-Date": date}
    if row["url"] is not None:
        fields["WARC-Target-URI"] = quote(row["url"], safe="".join(map(chr, range(33, 127))))
    if again:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(row["refers_to"])}
    fields |= {"WARC-Payload-Digest": f"sha256:{row['digest']}", "Content-Type": HTTP}
    return _record(fields, head if again else head + row["payload"])


def _record(fields: dict[str, str], block: bytes) -> bytes:
    fields = fields | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _put(out, record: bytes) -> int:
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.write(member.compress(record) + member.flush())


# --- reading -----------------------------------------------------------------------

_SCHEMA = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string())]
    + [("date", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def read_archives(archives: DataFrame, *, payload: bool = True, max_record_bytes: int = 256 << 20) -> DataFrame:
    """Reads the archives of a table (path, and perhaps content): a row for each record that is whole, and for each run of bytes
    that is not, with its `reason`: (path, offset, length, reason, type, record_id, target_uri, date, refers_to, payload_bytes,
    payload_digest, payload). Offsets and lengths are bytes of the file; records of a path and its gaps cover the file.

    A record is taken only if its member inflates with the right checksum, its head and length fit and its digests agree
    (SHA-1, SHA-256 and MD5, in hex or base 32; others are not checked). After a failed check the reader looks for the next place
    where a member or, in files without compression, a version line begins that passes; what lies between is one gap. A record with intact bounds
    and a wrong digest is a gap by itself, so that nothing inside its payload is taken for a record. Whether a file is compressed
    is told by its name, or else by its first bytes.

    Of HTTP responses the payload is what follows the HTTP head; a revisit has none, its bytes and digest are those its heads state.
    payload_digest is SHA-256 in lower-case hex, null where a revisit states another. Records of over `max_record_bytes` are gaps with the reason "too large".

    One task reads a file as a stream, never whole, through pyarrow's file systems (file, hdfs, s3, gs); for stores that
    only Spark reads, give `content` as the binaryFile source does. Null paths and empty files give no rows; a path twice is read twice. An empty table gives an empty one.
    """
    names = ["path", "content"] if "content" in archives.columns else ["path"]
    n = archives.count()

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for archive in batch.to_pylist():
                if archive["path"] is None:
                    continue
                for row in scan(open_archive(archive), archive["path"], payload, max_record_bytes):
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size >= _FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in _SCHEMA)
    return archives.select(*names).repartition(max(1, min(n, 100_000))).mapInArrow(read, kinds)


def quarantined(records: DataFrame) -> DataFrame:
    """(path, offset, length, reason): the byte gaps of read_archives()."""
    return records.filter("reason is not null").select("path", "offset", "length", "reason")


def resolved(records: DataFrame) -> DataFrame:
    """The whole records of read_archives(), written, with `resolved`: of a revisit, whether the response that it refers to was read
    with the digest it states, whose payload_bytes it then has; true for others. If responses share a record id, one with that digest is enough."""
    found = written(records.filter("reason is null").drop("payload", "reason"), "records")
    again = F.coalesce(F.col("type") == "revisit", F.lit(False))
    asked = found.filter(again).select("refers_to", "payload_digest").distinct()
    response = found.filter(~again).select(F.col("record_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("found_bytes"))
    known = written(response.join(asked, ["refers_to", "payload_digest"]).distinct(), "responses")
    revisits = found.filter(again).join(known, ["refers_to", "payload_digest"], "left")
    revisits = revisits.withColumn("payload_bytes", F.coalesce("found_bytes", "payload_bytes")).withColumn("resolved", F.col("found_bytes").isNotNull())
    return found.filter(~again).withColumn("resolved", F.lit(True)).unionByName(revisits.select(*found.columns, "resolved"))


def id_of_record(column: Column, kind: str) -> Column:
    """The id that record_id() made the column of."""
    return F.when(F.startswith(column, F.lit(_URN)), F.url_decode(F.replace(F.substring(column, len(_URN) + 1, 1 << 30), F.lit(">")))).cast(kind)


class Damaged(Exception):
    """No record is at this place; `skip`, its length where its bounds are intact."""

    def __init__(self, reason: str, skip: int = 0):
        super().__init__(reason)
        self.reason, self.skip = reason, skip


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system for a URI as Spark writes it, and the path there."""
    scheme, sep, rest = uri.partition(":")
    if not sep or scheme == "file":
        return pa.fs.LocalFileSystem(), re.sub("^/+", "/", rest if sep else uri)
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def open_archive(archive: dict) -> Window:
    if archive.get("content") is not None:
        return Window(pa.BufferReader(archive["content"]))
    fs, path = file_system(archive["path"])
    return Window(fs.open_input_file(path))


class Window:
    """Bytes of a file by place, of which a window is kept."""

    def __init__(self, file):
        self.file, self.size, self.start, self.bytes = file, file.size(), 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes from there; fewer only where the file ends."""
        if not self.start <= place <= place + n <= self.start + len(self.bytes):
            self.start, self.bytes = place, self.file.read_at(min(max(n, _WINDOW), max(0, self.size - place)), place)
        return self.bytes[place - self.start : place - self.start + n]

    def find(self, mark: bytes, place: int) -> int:
        """Where the mark is next, or the file's end."""
        while place < self.size:
            part = self.at(place, _WINDOW)
            if (k := part.find(mark)) >= 0:
                return place + k
            place += max(1, len(part) - len(mark) + 1)
        return self.size


def scan(file: Window, path: str, payload: bool, most: int) -> Iterator[dict]:
    """Rows of read_archives() for one file."""
    packed = path.endswith(".gz") or not path.endswith(".warc") and file.at(0, 2) == b"\x1f\x8b"
    mark, one = (b"\x1f\x8b\x08", _member) if packed else (b"WARC/1.", _plain)
    place, gap = 0, None
    while place < file.size:
        try:
            row, length = one(file, place, payload, most)
        except Damaged as damage:
            gap = gap or (place, damage.reason)
            place = place + damage.skip if damage.skip else file.find(mark, place + 1)
            continue
        if gap:
            yield {"path": path, "offset": gap[0], "length": place - gap[0], "reason": gap[1]}
            gap = None
        yield {"path": path, "offset": place, "length": length} | row
        place += length
    if gap:
        yield {"path": path, "offset": gap[0], "length": file.size - gap[0], "reason": gap[1]}


def _member(file: Window, place: int, payload: bool, most: int) -> tuple[dict, int]:
    """The record in the gzip member at a place, and the member's length."""
    inflate, out, at = zlib.decompressobj(31), bytearray(), place
    while not inflate.eof:
        part = file.at(at, _CHUNK)
        if not part:
            raise Damaged("truncated")
        try:
            out += inflate.decompress(part, most + 1 - len(out))
        except zlib.error as error:
            raise Damaged("not a whole gzip member") from error
        if len(out) > most:
            raise Damaged("too large")
        if len(out) >= len(VERSION) and not out.startswith(b"WARC/1."):
            raise Damaged("no version line")
        at += len(part)
    length = at - place - len(inflate.unused_data)
    head = out.find(b"\r\n\r\n", 0, _HEAD) + 4
    if head < 4:
        raise Damaged("no head", length)
    try:
        fields = fields_of(bytes(out[:head]))
        if len(out) != head + int(fields["content-length"]) + 4 or out[-4:] != b"\r\n\r\n":
            raise Damaged("wrong length")
        return facts(fields, bytes(memoryview(out)[head:-4]), payload), length
    except Damaged as damage:
        raise Damaged(damage.reason, length) from damage


def _plain(file: Window, place: int, payload: bool, most: int) -> tuple[dict, int]:
    """The record at a place of a file without compression, and its length."""
    start = file.at(place, _HEAD)
    head = start.find(b"\r\n\r\n") + 4
    if head < 4:
        raise Damaged("no head")
    fields = fields_of(start[:head])
    n = int(fields["content-length"])
    length = head + n + 4
    if file.at(place + head + n, 4) != b"\r\n\r\n":
        raise Damaged("truncated" if place + length > file.size else "wrong length")
    follows = file.at(place + length, 7)
    skip = length if not follows or follows == b"WARC/1." else 0
    if n > most:
        raise Damaged("too large", skip)
    try:
        return facts(fields, file.at(place + head, n), payload), length
    except Damaged as damage:
        raise Damaged(damage.reason, skip) from damage


def fields_of(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case; Damaged if it is not the head of a record."""
    if not re.match(rb"WARC/1\.\d\r\n", head):
        raise Damaged("no version line")
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8")).split("\r\n")[1:-2]
    except UnicodeDecodeError as error:
        raise Damaged("not a head") from error
    pairs = [line.partition(":") for line in lines]
    fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
    once = [name.strip().lower() for name, _, _ in pairs if name.strip().lower() != "warc-concurrent-to"]
    if len(once) > len(set(once)):
        raise Damaged("a field is repeated")
    if not all(sep for _, sep, _ in pairs) or not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        raise Damaged("not a head")
    if not all(fields.get(x) for x in ("warc-type", "warc-record-id", "warc-date")):
        raise Damaged("a field is missing")
    return fields


def facts(fields: dict[str, str], block: bytes, payload: bool) -> dict:
    """What read_archives() says of a record; Damaged if a digest is another."""
    http, again = fields.get("content-type", "").startswith("application/http"), fields["warc-type"] == "revisit"
    cut = block.find(b"\r\n\r\n") + 4 if http else 0
    said = fields.get("warc-payload-digest", "")
    if not same_digest(fields.get("warc-block-digest", ""), block):
        raise Damaged("wrong block digest")
    body = block[cut:] if not http or cut >= 4 else b""
    row = {"type": fields["warc-type"], "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "refers_to": fields.get("warc-refers-to")}
    if again:
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,15})\r$", block[:cut])
        return row | {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": said[7:].lower() if re.fullmatch("(?i)sha256:[0-9a-f]{64}", said) else None}
    if not same_digest(said, body):
        raise Damaged("wrong payload digest")
    return row | {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()} | ({"payload": body} if payload else {})


def same_digest(stated: str, data: bytes) -> bool:
    """Whether data has the digest that a field states; true of none and of algorithms that aren't known."""
    name, _, value = stated.partition(":")
    if (name := name.lower().replace("-", "")) not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(name, data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


