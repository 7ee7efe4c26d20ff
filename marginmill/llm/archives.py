"""Converting legacy web archives (ARC) to WARC.

An ARC file begins with a version block, whose second line says how the header lines of its records are laid out: version 1
has five fields, version 2 ten. A header line is followed by as many bytes as it declares. Each record becomes a WARC
record with a synthesised identifier (from the archive's name and the record's offset, so that a repeated task gives the
same), timestamp, type and digests. Of records with equal payloads one is the response, the others revisit it.

Archives are written by Spark's text writer and read by its binary file reader, so any store that Spark knows will do.
Both formats are records with a fixed text between them, which is the writer's line separator. A task handles one record
at a time; an archive is as large as the partition it was written from. Payloads that are no UTF-8 are stored in base64.
"""

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path

ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_END = "\r\n\r\n"
BATCH = 64
#: How hard gzip tries (a name that Hadoop knows): a third of the time of its own choice, six, for archives some 4 % larger.
GZIP_LEVEL = "FOUR"
RECORD = (
    "record_id string, page_id long, uri string, ip string, date string, mime string, http string, payload binary, "
    "payload_bytes long, payload_digest string"
)


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == BATCH:
            yield pa.RecordBatch.from_pylist(batch, schema)
            batch = []
    if batch:
        yield pa.RecordBatch.from_pylist(batch, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield from batch.slice(at, BATCH).to_pylist()


def _write_archives(records: DataFrame, path: str, end: str) -> None:
    """A gzip file for each partition, with `end` after each record."""
    options = {"lineSep": end, "compression": "gzip", "zlib.compress.level": GZIP_LEVEL}
    records.write.options(**options).text(path)


def _field(text: str | None) -> str:
    """A header field: without the white space that ends it."""
    return "".join(f"%{ord(c):02X}" if c.isspace() else c for c in text) if text else "-"


def arc_record(url: str | None, page_id: int | None, html: str | None, version: int, ip: str, date: str) -> str:
    body = html or ""
    size = len(body.encode())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n"
    head += f"X-Page-Id: {'' if page_id is None else page_id}\r\n\r\n"
    values = [_field(url), ip, date, "text/html", *(["200", "-", "-", "0", "-"] if version == 2 else [])]
    return f"{' '.join([*values, str(len(head.encode()) + size)])}\n{head}{body}"


def arc_version_block(version: int, date: str) -> str:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n"
    rest = ["200", "-", "-", "0", "-"] if version == 2 else []
    return f"{' '.join(['filedesc://pages.arc', '0.0.0.0', date, 'text/plain', *rest, str(len(body))])}\n{body}"


def write_arc(pages: DataFrame, version: int = 1, ip: str = "192.0.2.1", date: str = "20260101000000") -> str:
    """Write pages (page_id, url, html) as ARC files, one for each partition, and return their folder. Null html is an
    empty body, a null url is `-`."""

    def records(batches):
        def rows():
            first = True
            for r in _rows(batches):
                if first:
                    yield {"value": arc_version_block(version, date)}
                    first = False
                yield {"value": arc_record(r["url"], r["page_id"], r["html"], version, ip, date)}

        return _batches(rows(), pa.schema([("value", pa.string())]))

    path = new_path(pages.sparkSession, "arc")
    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write_archives(columns.mapInArrow(records, "value string"), path, "\n")
    return path


def _opened(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)


def read_arc(content: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """Offset, header fields by name, and body of each record after the version block."""
    stream = _opened(content)
    offset, fields = 0, None
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        body = stream.read(int(parts[-1]))
        offset += len(body)
        if len(body) != int(parts[-1]):
            raise ValueError(f"record at {start} is cut short: {len(body)} of {parts[-1]} bytes")
        if fields is None:
            lines = body.decode("ascii", "replace").splitlines()
            version = int(lines[0].split()[0])
            fields = lines[1].split() if len(lines) > 1 else ARC_FIELDS[version]
            continue
        if len(parts) != len(fields):
            raise ValueError(f"record at {start} has {len(parts)} fields, not {len(fields)}")
        yield start, dict(zip(fields, parts)), body


def _headers(head: str) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, mark, value in pairs if mark}


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_RECORD_SCHEMA = pa.schema(
    [(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))]
)


def converted(spark, path: str) -> DataFrame:
    """The records of all ARC files in a folder with what WARC adds: record_id, date, digest. http is the header of the
    response that was archived, page_id the number it carries."""

    def convert(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    name = batch.column(0)[i].as_py()
                    for offset, fields, body in read_arc(batch.column(1)[i].as_py()):
                        http, mark, payload = body.partition(b"\r\n\r\n")
                        if not mark or not http.startswith(b"HTTP/"):
                            http, payload = b"", body
                        head = http.decode("utf-8", "replace")
                        yield {
                            "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}")),
                            "page_id": _number(_headers(head).get("x-page-id")),
                            "uri": fields["URL"],
                            "ip": fields["IP-address"],
                            "date": _iso(fields["Archive-date"]),
                            "mime": fields["Content-type"],
                            "http": head,
                            "payload": payload,
                            "payload_bytes": len(payload),
                            "payload_digest": digest(payload),
                        }

        return _batches(rows(), _RECORD_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(convert, RECORD)


def _warc(headers: list[tuple[str, str]], block: str) -> str:
    lines = ["WARC/1.0", *(f"{n}: {v}" for n, v in headers), f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def warc_record(r: dict) -> str:
    payload = r["payload"] or b""
    coding = []
    try:
        text = payload.decode()
    except UnicodeDecodeError:
        text, coding = base64.b64encode(payload).decode(), [("X-Payload-Coding", "base64")]
    headers = [
        ("WARC-Type", "revisit" if r["original"] else "response"),
        ("WARC-Target-URI", r["uri"]),
        ("WARC-Date", r["date"]),
        ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"),
        ("WARC-IP-Address", r["ip"]),
        ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
    ]
    if r["original"]:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{r['original']}>"),
        ]
        block = r["http"] + "\r\n\r\n"
    else:
        block = f"{r['http']}\r\n\r\n{text}"
        headers += coding
    headers += [("WARC-Block-Digest", f"sha1:{digest(block.encode())}"), ("Content-Type", "application/http; msgtype=response")]
    return _warc(headers, block)


def write_warc(records: DataFrame, least_bytes: int = 0) -> str:
    """Write records as WARC files and return their folder. Of records with equal payloads of at least `least_bytes` that
    with the largest page_id (then record_id; without page_id last) is the response, the others revisit it. Payloads are
    moved once, by their digest; a digest that very many share is a hot key of a plain join, of which adaptive execution
    splits the shuffle."""
    keys = ["payload_digest", "payload_bytes"]
    newest = F.max(F.struct("page_id", "record_id"))["record_id"]
    groups = records.filter(F.col("payload_bytes") >= least_bytes).groupBy(*keys)
    groups = groups.agg(newest.alias("newest"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    other = F.when(F.col("newest") != F.col("record_id"), F.col("newest"))
    linked = records.join(groups, keys, "left").withColumn("original", other).drop("newest")

    def texts(batches):
        def rows():
            first = True
            for r in _rows(batches):
                if first:
                    yield {"value": _warc([("WARC-Type", "warcinfo"), ("WARC-Date", r["date"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'info ' + r['record_id'])}>"), ("Content-Type", "application/warc-fields")], "format: WARC File Format 1.0\r\n")}
                    first = False
                yield {"value": warc_record(r)}

        return _batches(rows(), pa.schema([("value", pa.string())]))

    path = new_path(records.sparkSession, "warc")
    _write_archives(linked.mapInArrow(texts, "value string"), path, WARC_END)
    return path


def read_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (small letters) and block of each record."""
    stream = _opened(content)
    while line := stream.readline():
        if not line.strip():
            continue
        head = [line.rstrip(b"\r\n").decode()]
        while (line := stream.readline()).strip():
            head.append(line.rstrip(b"\r\n").decode())
        headers = _headers("\r\n".join(head))
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def read_records(spark, path: str) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type, original (record_id that a revisit refers to) and
    payload (null for revisits) of all WARC records in a folder. Digests of responses are taken anew and must match."""

    def read(batches):
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for headers, block in read_warc(content.as_py()):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        revisit = headers["warc-type"] == "revisit"
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if headers.get("x-payload-coding") == "base64":
                            payload = base64.b64decode(payload)
                        told = headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and told != digest(payload):
                            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                        own = _headers(http.decode("utf-8", "replace"))
                        yield {
                            "record_id": headers["warc-record-id"][len("<urn:uuid:") : -1],
                            "page_id": _number(own.get("x-page-id")),
                            "payload_bytes": int(own.get("content-length", 0)) if revisit else len(payload),
                            "payload_digest": told,
                            "record_type": headers["warc-type"],
                            "original": headers["warc-refers-to"][len("<urn:uuid:") : -1] if revisit else None,
                            "payload": None if revisit else payload,
                        }

        return _batches(rows(), schema)

    kind = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, original string, payload binary"
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in kind.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, kind)


def page_records(pages: DataFrame, version: int = 1, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every page: written as ARC, converted to WARC and
    read back. Null html is an empty payload; repeated rows are records of their own, of which one is the response; pages
    without page_id keep none. Other columns are not read; an empty table gives an empty result."""
    spark = pages.sparkSession
    records = read_records(spark, write_warc(converted(spark, write_arc(pages, version)), least_bytes)).drop("payload")
    targets = records.filter("record_type = 'response'").select(F.col("record_id").alias("original"), F.col("page_id").alias("refers_to"))
    wanted = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.join(targets, "original", "left").select(*wanted)
