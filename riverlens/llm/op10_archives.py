"""Legacy web archives: ARC files are written, converted to WARC, and read back.

* ``write_arc`` puts pages into ARC files (version 1 or 2 by archive), each a
  version block and records of a header line, a declared length and a body.
* ``parse_arc`` reads the header line as the archive's version block describes
  it and takes bodies by their declared lengths, never by searching for ends.
* ``convert`` makes WARC records: identifiers derived from digest and page,
  ISO timestamps from 14-digit dates, base-32 SHA-1 digests, and types: of
  equal payloads the largest page_id is ``response``, the others ``revisit``.
* ``read_warc`` reads the archives back by their Content-Length fields.

Files go through Spark's writers and readers into the shared checkpoint
folder. The text sink writes raw bytes with a chosen record end, which gives
valid files (compressed whole): LF after an ARC record, CR LF CR LF after a
WARC record. An archive holds about ``ARCHIVE_BYTES``, so a task holds a few
archives at a time.

Nulls, ties, odd input: a null html is an empty payload; a null url gets a
placeholder URI; a null page_id stays null and counts as the smallest of its
group (if all are null, all are response); rows that repeat the largest
page_id are response as well; blanks in urls are percent-encoded; a body
shorter than declared is kept and marked as truncated; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ARCHIVE_BYTES = 4 << 20
MIN_PAYLOAD = 0                       # fixed value: payloads of at least so many bytes are de-duplicated
CAPTURED = "20260101000000"           # pages carry no capture date
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-arc-to-warc")

# Field names of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/archives/{name}-{uuid.uuid4().hex[:12]}"


# -------------------------------------------------------------------- writing
def arc_header(url: str, length: int, version: int, archive: int, kind: str = "text/html") -> bytes:
    """Header line of a record; blanks and control characters of a url would end its field, so they are encoded."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    middle = [] if version == 1 else ["200", "-", "-", "0", f"{archive}.arc"]
    return " ".join([url, "0.0.0.0", CAPTURED, kind, *middle, str(length)]).encode() + b"\n"


def arc_file(archive: int, version: int, bodies: list[tuple[str, bytes]]) -> bytes:
    """An ARC file without its last line feed: a version block, then one record per (url, body)."""
    block = f"{version} 0 riverlens\n{ARC_FIELDS[version]}\n".encode()
    first = arc_header(f"filedesc://{archive}.arc", len(block), version, archive, "text/plain") + block
    return b"\n".join([first, *(arc_header(url, len(body), version, archive) + body for url, body in bodies)])


def write_arc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write pages as ARC files, versions 1 and 2 in turn; returns their folder.

    Each task fills archives from the rows that it reads, so nothing is
    shuffled; an archive's number is its task's partition and a count.
    """
    path = _folder(pages.sparkSession, "arc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, size, bodies = 0, 0, []

        def full() -> pd.DataFrame:
            archive = TaskContext.get().partitionId() * 1_000_000 + count
            return pd.DataFrame({"archive": [archive], "value": [arc_file(archive, count % 2 + 1, bodies)]})
        for batch in batches:
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                payload = (html or "").encode()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page else "")
                body = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                bodies.append((f"urn:x-page:{page or 'none'}" if url is None else url, body))
                size += len(body) + 200
                if size >= archive_bytes:
                    yield full()
                    count, size, bodies = count + 1, 0, []
        if bodies:
            yield full()

    # the id travels as a string, so a null among long ids stays exact
    files = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "archive long, value binary")
    _write_files(files, path, "\n")
    return path


def _write_files(files: DataFrame, path: str, end: str) -> None:
    """One compressed file per row (archive, value): the text sink writes the bytes as they are, then ``end``."""
    (files.select("archive", F.col("value").cast("string").alias("value"))
          .write.partitionBy("archive").option("lineSep", end).option("compression", "gzip").text(path))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content): one row per archive file, a file being one unit of work."""
    if not spark.read.format("binaryFile").load(path).columns.count("archive"):
        return spark.createDataFrame([], "archive long, content binary")    # no page, no archive
    return spark.read.format("binaryFile").load(path).select(F.col("archive").cast("long").alias("archive"), "content")


# -------------------------------------------------------------------- reading
def arc_records(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, after its version block."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    version_block = data[end + 1:end + 1 + length].split(b"\n")
    version = int(version_block[0].split(b" ", 1)[0])
    fields = ARC_FIELDS[version].split(" ")
    at = end + 1 + length
    while at < len(data):
        if data[at:at + 1] == b"\n":   # the separator before a record
            at += 1
            continue
        end = data.index(b"\n", at)
        values = dict(zip(fields, data[at:end].split(b" "), strict=True))
        body = data[end + 1:end + 1 + int(values["Archive-length"])]
        head, _, payload = body.partition(b"\r\n\r\n")
        page = next((int(x[11:]) for x in head.split(b"\r\n") if x.startswith(b"X-Page-Id: ")), None)
        yield {"offset": at, "url": values["URL"], "ip": values["IP-address"], "date": values["Archive-date"], "type": values["Content-type"],
               "head": head, "payload": payload, "page_id": page, "truncated": len(body) < int(values["Archive-length"])}
        at = end + 1 + len(body)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame whose page_id keeps all digits beside nulls."""
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    out["page_id"] = pd.array(out["page_id"], dtype="Int64")
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, data in zip(batch["archive"], map(gzip.decompress, batch["content"]), strict=True):
            rows = [(archive, r["offset"], r["page_id"], payload_digest(r["payload"]), len(r["payload"])) for r in arc_records(data)]
            yield _frame(rows, ["archive", "offset", "page_id", "digest", "bytes"])


def parse_arc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, page_id, digest, bytes) of every record below ``path``."""
    return _archives(spark, path).mapInPandas(_parse, "archive long, offset long, page_id long, digest string, bytes long")


def record_id(digest: str, page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{digest}/{page_id}')}>"


def _iso(date: bytes) -> str:
    d = date.decode()
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _to_warc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, data, keep in zip(batch["archive"], map(gzip.decompress, batch["content"]), batch["best"], strict=True):
            best = {} if keep is None else {int(x["offset"]): x["best"] for x in keep}
            out = [_warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", archive)), ("WARC-Date", _iso(CAPTURED.encode())),
                          ("Content-Type", "application/warc-fields")], b"software: riverlens\r\nformat: WARC File Format 1.1\r\n")]
            for r in arc_records(data):
                digest, of = payload_digest(r["payload"]), best.get(r["offset"])
                fields = [("WARC-Target-URI", r["url"].decode()), ("WARC-Date", _iso(r["date"])), ("WARC-IP-Address", r["ip"].decode()),
                          ("WARC-Record-ID", record_id(digest, r["page_id"])), ("WARC-Payload-Digest", f"sha1:{digest}"),
                          ("Content-Type", "application/http; msgtype=response")]
                fields += [("WARC-Truncated", "length")] if r["truncated"] else []
                if of is None or pd.isna(of):
                    out.append(_warc([("WARC-Type", "response"), *fields], r["head"] + b"\r\n\r\n" + r["payload"]))
                else:
                    out.append(_warc([("WARC-Type", "revisit"), ("WARC-Refers-To", record_id(digest, int(of))),
                                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *fields], r["head"] + b"\r\n\r\n"))
            yield pd.DataFrame({"archive": [archive], "value": [b"\r\n\r\n".join(out)]})


def convert(spark: SparkSession, arc_path: str, min_payload: int = MIN_PAYLOAD) -> str:
    """Convert every ARC archive to a WARC archive; returns the folder of the WARC files."""
    path = _folder(spark, "warc")
    parsed = parse_arc(spark, arc_path)
    firsts = parsed.filter(F.col("bytes") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("best"))
    revisits = parsed.join(firsts, "digest").filter("best is not null and not (page_id <=> best)")
    # one row per archive, as large as the archive's own record count
    by_archive = revisits.groupBy("archive").agg(F.collect_list(F.struct("offset", "best")).alias("best"))
    warc = _archives(spark, arc_path).join(by_archive, "archive", "left").mapInPandas(_to_warc, "archive long, value binary")
    _write_files(warc, path, "\r\n\r\n")
    return path


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + length]
        at = end + 4 + length + 4


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers"]
    for batch in batches:
        for data in map(gzip.decompress, batch["content"]):
            rows = []
            for fields, block in warc_records(data):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                size = len(payload) if fields["WARC-Type"] == "response" else int(http["Content-Length"])
                rows.append((int(http["X-Page-Id"]) if "X-Page-Id" in http else None, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                             fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
            yield _frame(rows, columns)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record of the WARC files below ``path``."""
    return _archives(spark, path).mapInPandas(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string")


def op10_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The op10 contract over ``pages``."""
    path = convert(spark, write_arc(pages))
    records = read_warc(spark, path)
    targets = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")).distinct()
    return records.join(targets, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
