"""ARC archives, their conversion to WARC, and reading WARC back.

Pages are written as ARC records (version 1 or 2), the archives are parsed by
the header line of their version and the lengths it declares, and every record
becomes its WARC equivalent: an identifier, a timestamp, a type and digests.
Records with equal payloads become revisits of the one with the largest page_id.

Archives are written and read by Spark's own text and binary-file formats, so
any store that Spark reads will do.  Pages are dealt anew where a
file would hold over twice ``ARCHIVE_BYTES``, since a reader takes a whole file at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, new_path, remove

ARCHIVE_BYTES = 32 << 20
#: Repeated payloads are broadcast while they are fewer than this (some dozens of bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Fields of a record's header line by version of the format.  Fixed values.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
DATE = "20240101000000"
PAGE = "urn:page:"


def arc_start(name: str, version: int) -> bytes:
    """The version block that begins an archive, without the newline after it."""
    body = b"%d 0 framelathe\n%s\n" % (version, " ".join(ARC_FIELDS[version]).encode())
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(url: str | None, page_id: int | None, payload: bytes, version: int) -> bytes:
    """An ARC record around an HTTP response, without the newline after it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    safe = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"
    values = {
        "URL": safe, "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/html", "Result-code": "200",
        "Filename": "-" if page_id is None else f"{PAGE}{page_id}", "Archive-length": str(len(http) + len(payload)),
    }
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + http + payload


def inflate(raw: bytes) -> bytes:
    """All members of a gzip file; what isn't gzip stays as it is."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw))
        raw = d.unused_data
    return b"".join(out)


def parse_arc(raw: bytes):
    """Header fields and content of each record after the version block."""
    raw = inflate(raw)
    end = raw.index(b"\n")
    first = raw[:end].split(b" ")
    length = int(first[-1])
    body = raw[end + 1 : end + 1 + length]
    version = int(body.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    names = ARC_FIELDS[version]
    at = end + 1 + length
    while True:
        while raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(raw):
            return
        end = raw.index(b"\n", at)
        values = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(values) != len(names):
            raise ValueError(f"a version {version} header has {len(names)} fields: {values!r}")
        fields = dict(zip(names, values))
        length = int(fields["Archive-length"])
        yield at, fields, raw[end + 1 : end + 1 + length]
        at = end + 1 + length


def parse_warc(raw: bytes):
    """Named fields and block of each record."""
    raw = inflate(raw)
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            return
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        length = int(fields["content-length"])
        yield fields, raw[end + 4 : end + 4 + length]
        at = end + 4 + length


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_of(content: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with the empty line after them, and the entity."""
    if content.startswith(b"HTTP/"):
        end = content.find(b"\r\n\r\n")
        if end >= 0:
            return content[: end + 4], content[end + 4 :]
    return b"", content


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def stamp(date14: str) -> str:
    """YYYYMMDDhhmmss as YYYY-MM-DDThh:mm:ssZ; missing places count as their lowest value."""
    d = (re.sub(r"\D", "", date14) + "00000101000000"[len(re.sub(r"\D", "", date14)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def write_arc(pages: DataFrame, path: str, *, version: int = 2, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped ARC files; null html is empty, other columns are not looked at.

    Version 1 has no place for the page_id: it is lost.
    """
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    each = plain.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("html").cast("long")).alias("n"))
    size, most = each.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) > 2 * archive_bytes:
        plain = plain.repartition(-(-size // archive_bytes))

    def run(batches):
        out, held = [arc_start(f"{uuid.uuid4().hex}.arc", version)], 0
        for b in batches:
            html = b.column(2).cast(pa.binary())
            for i in range(b.num_rows):
                out.append(arc_record(b.column(1)[i].as_py(), b.column(0)[i].as_py(), html[i].as_py() or b"", version))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    text = plain.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


#: What parsing a damaged archive may raise.
DAMAGE = (ValueError, KeyError, IndexError, zlib.error)


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """``path, records, error`` of ARC files that can't be read to their end: what a run that isn't strict leaves out."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                n = 0
                try:
                    for _ in parse_arc(raw.as_py()):
                        n += 1
                except DAMAGE as e:
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "error": [f"{type(e).__name__}: {e}"]})

    return archives(spark, path).mapInArrow(run, "path string, records long, error string")


def read_to_damage(records, strict: bool):
    try:
        yield from records
    except DAMAGE:
        if strict:
            raise


def arc_records(spark: SparkSession, path: str, *, content: bool = True, strict: bool = True) -> DataFrame:
    """``page_id, url, ip, date, mime, digest, bytes, http, payload`` of the records in ARC files.

    Without ``content`` the last two are left out.  A damaged file raises, or if
    not ``strict`` gives the records before the damage; ``damaged`` lists them.
    """
    names = ["page_id", "url", "ip", "date", "mime", "digest", "bytes"] + ["http", "payload"] * content
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()] + [pa.binary(), pa.binary()] * content
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for b in batches:
            for raw in b.column(1):
                rows, held = [], 0
                for _, f, block in read_to_damage(parse_arc(raw.as_py()), strict):
                    http, payload = payload_of(block)
                    name = f.get("Filename", "-")
                    page = int(name[len(PAGE) :]) if name.startswith(PAGE) else None
                    row = [page, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], digest(payload), len(payload)]
                    rows.append(row + [http, payload] * content)
                    held += len(block) * content + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    kind = "page_id long, url string, ip string, date string, mime string, digest string, bytes long" + ", http binary, payload binary" * content
    return archives(spark, path).mapInArrow(run, kind)


def convert(spark: SparkSession, arc: str, warc: str, *, least_bytes: int = 0, strict: bool = True) -> None:
    """Write the WARC equivalent of the ARC files under ``arc``.

    Of records with equal payloads of at least ``least_bytes`` the one with the
    largest page_id is the response (rows that repeat it too), others revisit
    it; records without a page_id are responses.  Records that repeat a page_id
    bear one WARC-Record-ID.  No pages: archives without records.
    """
    again = (
        arc_records(spark, arc, content=False, strict=strict)
        .filter((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("_to"), F.min("page_id").alias("_from"))
        .filter("_to > _from")
        .select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "_to")
    )
    again = cut(again, "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = arc_records(spark, arc, strict=strict).join(again, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")
    rows = rows.select("page_id", "url", "ip", "date", "mime", "digest", "http", "payload", F.when(F.col("page_id") < F.col("_to"), F.col("_to")).alias("to"))

    def run(batches):
        out = [warc_record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": stamp(DATE), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")]
        held = 0
        for b in batches:
            for page, url, ip, date, mime, sha, http, payload, to in zip(*(c.to_pylist() for c in b.columns)):
                name = f"<{PAGE}{page}>" if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {sha}')}>"
                fields = {"WARC-Record-ID": name, "WARC-Date": stamp(date), "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha}"}
                if ip != "0.0.0.0":
                    fields["WARC-IP-Address"] = ip
                fields["Content-Type"] = "application/http; msgtype=response" if http else mime
                if to is None:
                    block = http + payload
                    kind = "response" if http else "resource"
                else:
                    block, kind = http, "revisit"
                    fields |= {"WARC-Refers-To": f"<{PAGE}{to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                fields["WARC-Block-Digest"] = f"sha1:{digest(block)}"
                out.append(warc_record(kind, fields, block))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, held = [], 0
        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    text = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(warc)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records in WARC files.

    A response's length and digest are counted anew and must equal the declared
    ones; a revisit's are those of the record it revisits, as declared.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: int(x[len(PAGE) + 1 : -1]) if x.startswith(f"<{PAGE}") else None

    def run(batches):
        for b in batches:
            for raw in b.column(1):
                rows = []
                for f, block in parse_warc(raw.as_py()):
                    kind = f["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = payload_of(block)
                    sha = f["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    else:
                        n = len(payload)
                        if digest(payload) != sha:
                            raise ValueError(f"payload of {f['warc-record-id']} is damaged")
                    rows.append((number(f["warc-record-id"]), n, sha, kind, number(f.get("warc-refers-to", ""))))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, schema)], schema=schema)

    return archives(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_query(spark, sf_dir: str) -> DataFrame:
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    convert(spark, arc, warc)
    remove(spark, arc)
    return read_warc(spark, warc)


_BITS = " || ".join(
    f"list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], "
    f"1 + strpos('0123456789abcdef', substr(h, {i + 1}, 1))::INT - 1)"
    for i in range(40)
)
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16*substr(b,{5 * i + 1},1)::INT + 8*substr(b,{5 * i + 2},1)::INT + 4*substr(b,{5 * i + 3},1)::INT "
    f"+ 2*substr(b,{5 * i + 4},1)::INT + substr(b,{5 * i + 5},1)::INT, 1)"
    for i in range(32)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, max(page_id) AS top FROM p GROUP BY t),
s AS (SELECT page_id, strlen(t)::BIGINT AS n, sha1(t) AS h, top FROM p JOIN g USING (t)),
x AS (SELECT *, {_BITS} AS b FROM s)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM x
"""
