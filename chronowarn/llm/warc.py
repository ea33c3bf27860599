"""Legacy ARC archives converted to WARC: rendering, parsing by declared lengths, synthesis and reading back."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chronowarn.llm.shared import written

ARCHIVE_BYTES = 8 << 20   # wanted size of an archive file; a longer record has a file's worth of its own
REVISIT_BYTES = 100       # shortest payload that a revisit may stand for
EPOCH = dt.datetime(2001, 1, 1)
RECORD_END = "\r\n\r\n"
ARC_FIELDS = {  # fixed values: the header line of each version of the format
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC standard


def _line_url(url: str | None, page: int | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else f"urn:page:{page}"


def arc_text(page: int | None, url: str | None, html: str | None, version: int) -> str:
    """One ARC record: header line, HTTP response of the declared length, and nothing after it."""
    body = html or ""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + f"Content-Length: {len(body.encode())}\r\n\r\n"
    block = head + body
    date = (EPOCH + dt.timedelta(seconds=(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
    values = {"url": _line_url(url, page), "ip": "0.0.0.0", "date": date, "type": "text/html", "status": "200", "checksum": "-", "location": "-",
              "offset": "0", "filename": "legacy.arc", "length": str(len(block.encode()))}
    return " ".join(values[f] for f in ARC_FIELDS[version]) + "\n" + block


def parse_arc(data: bytes):
    """Yield (fields, HTTP head, body) of an ARC file, each record by its declared length.

    The number of fields of a header line tells its version; blank lines between records are skipped.  A line that
    fits no version, or a length beyond the end of the file, raises ValueError: a damaged archive is not guessed at.
    """
    at = 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        parts = data[at : end if end >= 0 else len(data)].decode().rstrip("\r").split(" ")
        version = next((v for v, names in ARC_FIELDS.items() if len(names) == len(parts)), None)
        if end < 0 or version is None or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line at byte {at}")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"ARC record at byte {at} is shorter than declared")
        head, _, body = block.partition(b"\r\n\r\n")
        yield dict(zip(ARC_FIELDS[version], parts)) | {"version": version}, head.decode(), body
        at = end + 1 + length


def parse_warc(data: bytes):
    """Yield (named fields in lower case, block) of a WARC file, each record by its declared length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if end < 0 or not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"not a WARC record at byte {at}")
        start, length = end + 4, int(fields["content-length"])
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} has not its declared length")
        yield fields, data[start : start + length]
        at = start + length + 4


def record_id(digest: str, page: int | None, date: str, url: str) -> str:
    """A name made from what the record is, so a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{date}|{digest}|{url}')}>"


def warc_text(page: int | None, url: str, date: str, ip: str, head: str, body: str, digest: str, original: int | None, version: int) -> str:
    """WARC/1.1 record of a parsed ARC record, without the closing blank lines; ``original`` makes it a revisit."""
    when = dt.datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    block = f"{head}\r\n\r\n" + (body if original is None else "")
    raw = block.encode()
    fields = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", record_id(digest, page, date, url)), ("WARC-Date", when),
              ("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(raw).hexdigest()}"), ("WARC-Converted-From", f"arc/{version}")]
    if original is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", str(original))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(raw)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block


def _per_file(df: DataFrame, bytes_column) -> int:
    """Records of a mean archive of ``ARCHIVE_BYTES``; the writer starts a new file after so many."""
    size = df.agg(F.avg(bytes_column)).first()[0] or 0
    return max(1, int(ARCHIVE_BYTES // max(1, size)))


def _save(records: DataFrame, folder: str, end: str, per_file: int) -> str:
    """Write the string column ``value`` as gzipped archive files through Spark's own writer, so any store will do."""
    records.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(folder)
    return folder


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def _to_arc(batches):
    for batch in batches:
        ids, urls, pages = (batch.column(i).to_pylist() for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array([arc_text(p, u, h, 1 + (p or 0) % 2) for p, u, h in zip(ids, urls, pages)], pa.string())], ["value"])


def _page_of(head: str) -> int | None:
    found = re.search(r"\r\nX-Page-Id: (-?\d+)", head)
    return int(found[1]) if found else None


ARC_ROW = "page_id long, url string, date string, ip string, version int, head string, body string, payload_bytes long, payload_digest string"


def _from_arc(batches):
    names = [c.split()[0] for c in ARC_ROW.split(", ")]
    for batch in batches:
        for data in batch.column(0):
            rows, held = [], 0
            for f, head, body in parse_arc(gzip.decompress(data.as_py())):
                rows.append((_page_of(head), f["url"], f["date"], f["ip"], f["version"], head, body.decode(), len(body), hashlib.sha256(body).hexdigest()))
                held += len(body)
                if held > 4 << 20:
                    yield _rows(rows, names)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, names)


def _rows(rows, names):
    types = {"version": pa.int32(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "block_ok": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def _to_warc(batches):
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(9)))
        yield pa.RecordBatch.from_arrays([pa.array([warc_text(*r) for r in rows], pa.string())], ["value"])


WARC_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string, block_ok boolean"


def _from_warc(batches):
    names = [c.split()[0] for c in WARC_ROW.split(", ")]
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for f, block in parse_warc(gzip.decompress(data.as_py())):
                head, _, body = block.partition(b"\r\n\r\n")
                text = head.decode()
                length = int(re.search(r"\r\nContent-Length: (\d+)", text)[1])
                digest = f["warc-payload-digest"].partition(":")[2]
                whole = f["warc-type"] == "revisit" or (len(body) == length and hashlib.sha256(body).hexdigest() == digest)
                whole = whole and hashlib.sha256(block).hexdigest() == f["warc-block-digest"].partition(":")[2]
                rows.append((_page_of(text), length, digest, f["warc-type"], int(f["warc-refers-to-page"]) if "warc-refers-to-page" in f else None,
                             f["warc-record-id"], f["warc-date"], f["warc-target-uri"], whole))
            if rows:
                yield _rows(rows, names)


def write_arc(pages: DataFrame, folder: str) -> str:
    """``pages`` (page_id, url, html) as ARC files, header lines of version 1 and 2 by turns."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    per_file = _per_file(rows, F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 400)
    return _save(rows.mapInArrow(_to_arc, "value string"), folder, "\n", per_file)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str) -> str:
    """Convert every ARC file of a folder to WARC.

    Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the smallest page id is the response and the
    others revisit it.  Originals are found by a partial aggregate over digests; only digests that occur more than
    once are joined back.  The archives are parsed twice, once for digests and once to convert, so that no payload is
    stored besides the archives.  Identifiers are named after page, date, digest and URL, so a task that is run again
    writes the same record.
    """
    parsed = _archives(spark, arc_folder).mapInArrow(_from_arc, ARC_ROW)
    seen = written(parsed.select("page_id", "payload_bytes", "payload_digest"), "arc-digests")
    originals = seen.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(
        F.min("page_id").alias("_original"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("payload_digest", "_original")
    known = seen.select("page_id", "payload_digest").join(originals, "payload_digest").where("page_id <> _original")
    known = written(known.select("page_id", "payload_digest", "_original").distinct(), "revisits")
    rows = parsed.join(known, ["page_id", "payload_digest"], "left").withColumn("_original", F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("_original")))
    rows = rows.select("page_id", "url", "date", "ip", "head", F.when(F.col("_original").isNull(), F.col("body")).otherwise("").alias("body"), "payload_digest", "_original", "version")
    return _save(rows.mapInArrow(_to_warc, "value string"), warc_folder, RECORD_END, _per_file(seen, F.col("payload_bytes") + 900))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of a folder of WARC files; ``block_ok`` says that lengths and digests hold."""
    return _archives(spark, folder).mapInArrow(_from_warc, WARC_ROW)


def round_trip(pages: DataFrame, root: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC read back: one row per page.

    Null html is an empty payload; null url becomes ``urn:page:<id>``; null page_id stays null and is never a
    response for others nor a revisit.  Rows that repeat a page_id and payload are all responses of that id.
    Empty input gives no rows.  Extra columns are ignored.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, f"{root}/arc")
    return read_warc(spark, convert(spark, arc, f"{root}/warc"))
