"""WARC 1.1 archives: writing captures, reading records, and assembling transactions.

write_archives() makes three records of each page, a response (or a revisit of an earlier equal
payload), a request and a metadata record, the latter two concurrent to the first, with column
expressions alone; Spark's text writer puts them in gzip files of bounded size. read_records() parses
archives by their records' lengths. assemble() joins request, response and metadata records through
their concurrent-to identifiers, in either direction and over one record between, and gives one
nested row per capture.

Defined cases: null html is an empty payload; a null url is an empty target; control characters and
spaces in urls are percent-encoded; a null page_id comes back as null, and such a page never revisits;
repeated rows are captures of their own, and repeats of the smallest page_id of a payload are all
responses; an empty table gives a folder without records and an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm.common import new_folder, small_batches, table, written

CRLF = "\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 100
#: Records of a file at most, which bounds what a reader holds.
FILE_RECORDS = 12_000
#: Payloads that occur more than once, of some 100 bytes each, that are broadcast at most.
BROADCAST_GROUPS = 400_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, content_type string, fields map<string,string>, payload_bytes long, payload_sha256 string, block binary"


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without the two line ends that follow it; a header of null is left out."""
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(CRLF * 2), block)


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), " ", "%20"), r"[\x00-\x1f\x7f]", "%0A")


def classify(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, original): original is the page whose equal payload a page revisits, or null."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), _uri(F.col(url_col).cast("string")).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    # The join key is null for rows that can't repeat, and those never meet a group.
    sized = rows.withColumn("key", F.when((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull(), F.col("digest")))
    groups = written(sized.where("key is not null").groupBy("key").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("key", "original"), "warc-groups")
    # Payloads are shuffled only if the payloads that repeat are too many to be handed to every task.
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    joined = sized.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), "digest"))).join(groups, "key", "left")
    return joined.withColumn("original", F.when(F.col("page_id") != F.col("original"), F.col("original"))).drop("key")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    rows = classify(pages, id_col, url_col, html_col, least_bytes)
    revisit, size = F.col("original").isNotNull(), F.octet_length("payload").cast("string")
    main, digest = _urn("response", F.col("page_id"), F.col("digest")), F.concat(F.lit("sha256:"), "digest")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")], F.concat(http, "payload"))
    again = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("response", F.col("original"), F.col("digest"))), ("Content-Type", "application/http;msgtype=response")], http)
    place = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], F.concat(F.lit("GET "), F.when(place == "", F.lit("/")).otherwise(place), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("payload-bytes: "), size, F.lit(CRLF))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], about)
    records = rows.select(F.explode(F.array(F.when(revisit, again).otherwise(response), request, metadata)).alias("value"))
    # A record and the separator after it are what the format asks for.
    records.write.options(lineSep=CRLF * 2, compression="gzip", maxRecordsPerFile=FILE_RECORDS).text(folder)


def _parse(data: bytes, with_block: bool) -> Iterator[dict]:
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, list[str]] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head.setdefault(k.strip().lower(), []).append(v.strip())
        one = lambda k: head.get(k, [None])[0]  # noqa: B023, E731
        size = int(one("content-length") or 0)
        block = f.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends early")
        kind, content = one("warc-type"), one("content-type") or ""
        fields, payload = [], block
        if content.startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif content.startswith("application/warc-fields"):
            fields = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if c]
        yield {
            "record_id": one("warc-record-id"), "type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": head.get("warc-concurrent-to", []),
            "refers_to": one("warc-refers-to"), "payload_digest": one("warc-payload-digest"), "content_type": content, "fields": dict(fields),
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest() if kind == "response" else None, "block": block if with_block else None,
        }


_ARROW = pa.schema([(n, pa.string()) for n in ("record_id", "type", "target_uri", "date")] + [("concurrent_to", pa.list_(pa.string()))] + [(n, pa.string()) for n in ("refers_to", "payload_digest", "content_type")] + [("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("block", pa.binary())])


def read_records(spark: SparkSession, folder: str, with_block: bool = True) -> DataFrame:
    """A row for each record of the archives in folder, gzipped or not."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column("content"):
                rows = []
                for r in _parse(data.as_py(), with_block):
                    rows.append(r | {"fields": list(r["fields"].items())})
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(folder).select("content").mapInArrow(work, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, target_uri, date, response, requests, metadata)."""
    is_main = F.col("type").isin("response", "revisit", "resource")
    mains, others = records.where(is_main), records.where(F.col("type").isin("request", "metadata"))
    named = others.select(F.col("record_id").alias("own"), F.explode("concurrent_to").alias("to"))
    said = mains.select(F.explode("concurrent_to").alias("own"), F.col("record_id").alias("to"))
    direct = named.unionByName(said).distinct()
    # A metadata record may be concurrent to the request alone.
    over = direct.alias("x").join(direct.alias("y"), F.col("x.to") == F.col("y.own")).select("x.own", "y.to")
    links = direct.unionByName(over).distinct()
    parts = others.join(links, others["record_id"] == links["own"]).groupBy("to").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "content_type", F.map_entries("fields").alias("fields"), "block")))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))]
    )
    response = F.struct("type", "payload_bytes", "payload_digest", "payload_sha256", "refers_to", "block").alias("response")
    rows = mains.select(F.col("record_id").alias("capture_id"), "target_uri", "date", response)
    return rows.join(parts, rows["capture_id"] == parts["to"], "left").drop("to")


def op3_warc(spark, sf_dir):
    small_batches(spark)
    folder = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    # Parsed once: assembly reads the records several times over.
    captures = assemble(written(read_records(spark, folder, with_block=False), "warc-records"))
    entries = F.map_from_entries(F.col("metadata")[0]["fields"])
    rows = captures.select("capture_id", entries["page-id"].cast("long").alias("page_id"), "response.*")
    responses = rows.where("type <> 'revisit'").select("page_id", "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    originals = rows.where("type <> 'revisit'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("bytes")).dropDuplicates(["refers_to"])
    revisits = rows.where("type = 'revisit'").join(originals, "refers_to").select("page_id", F.col("bytes").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), F.col("type").alias("record_type"), F.col("original").alias("refers_to"))
    return responses.unionByName(revisits)


SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha256(h) as payload_digest from p),
g as (select payload_digest, min(page_id) as original from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when d.page_id <> g.original then 'revisit' else 'response' end as record_type,
       case when d.page_id <> g.original then g.original end as refers_to
from d left join g on d.payload_digest = g.payload_digest and d.payload_bytes >= 100
"""
