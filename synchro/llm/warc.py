"""WARC archives: write captures, read them back, assemble transactions (operator 7).

A capture is three records: a request, a response (or a revisit, if an earlier page has the same
payload), and metadata.  Request and metadata name the response in WARC-Concurrent-To; a revisit names the
response's record in WARC-Refers-To, and its profile is that of identical payloads.  Requests and responses hold HTTP
messages, so the payload is what follows the head.  Pages with
equal payloads are found by aggregating digests (the smallest page_id of each), so no group of equal
pages comes together in a task.  Records are UTF-8 strings, and Spark writes them with the blank lines
that end a record as line separator, into gzip files.  Pages are written by classes of size, each
with its own number of records a file, so a file holds FILE_BYTES of pages at most, or one larger page.  Reading streams through a file
record by record, by Content-Length, in Arrow batches.  Transactions are assembled by joins on the
concurrent-to ids; the payload of a revisit is its response's.

Null html is an empty payload.  Of rows that repeat a page_id each is a capture of its own, told apart by url and payload, and
wholly equal ones by a number; of those with the payload's smallest page_id the first by url is the response, the others revisit it.
A null page_id is written as empty and read back as null; such a page is a response.
Extra columns are not written.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payloads under this many bytes are always responses.
LEAST_PAYLOAD = 0
#: Bytes of pages in a file, and of the largest page of the first class; a class's largest page is STEP times that of the one before.
FILE_BYTES, SMALL_PAGE, STEP = 128 << 20, 64 << 10, 16
#: Records, and bytes of what they hold, in a batch that reading hands on.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
_END = "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: the standard's name for a revisit of an identical payload.
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest):
    """Bare upper-case base32 of a SHA-1 in hex: every 20 bits are 4 letters."""
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


_WHO = ["page_id", "url", "sha"]


def _told(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes and the payload's SHA-1 (sha)."""
    pages = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return pages.withColumns({"bytes": F.octet_length("html").cast("long"), "sha": F.sha1(F.col("html").cast("binary"))})


def marks(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, sha, bytes, times (how many equal rows there are), first (page_id, own, url, sha of the payload's response, null where it has no second), written without html."""
    rows = _told(pages).groupBy(_WHO).agg(F.first("bytes").alias("bytes"), F.count("*").alias("times"))
    rows = C.saved(rows, "captures")
    counted = (F.col("bytes") >= least) & F.col("page_id").isNotNull()
    shared = rows.where(counted).groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("least"), F.sum("times").alias("n")).where("n > 1")
    first = F.struct("least.page_id", F.lit(0).cast("long").alias("own"), "least.url", "sha").alias("first")
    rows = rows.join(shared.select("sha", first), "sha", "left").select(*_WHO, "bytes", "times", F.when(counted, F.col("first")).alias("first"))
    return C.saved(rows, "marks")


def captures(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """page_id, own (the number among equal rows), url, html, bytes, sha, first (page_id, own, url and sha of the response for a revisit, else null).

    known: the `marks` of the table that pages is from.  Nothing here hangs on where a row lies: rows are told apart by what they hold, and rows
    that are wholly equal are made one and numbered again, so any evaluation of pages gives the same captures.
    """
    known = marks(pages) if known is None else known
    known = known.select(*(F.col(c).alias(f"_{c}") for c in _WHO), "times", "first")
    special = known.where("times > 1 OR first IS NOT NULL")  # other rows are responses by themselves
    same = F.lit(True)
    for c in _WHO:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = _told(pages).join(special, same, "left").drop(*(f"_{c}" for c in _WHO))
    one = F.coalesce("times", F.lit(1)) == 1
    out = rows.where(one).withColumn("own", F.lit(0).cast("long"))
    if not known.where("times > 1").isEmpty():
        # equal rows: one holds the payload, the others revisit it (or hold it too, where they are responses)
        many = rows.where(~one).groupBy(_WHO).agg(*(F.first(c).alias(c) for c in ("html", "bytes", "times", "first")))
        many = many.withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        out = out.unionByName(many)
    me = (F.col("page_id") == F.col("first.page_id")) & (F.col("url") == F.col("first.url")) & (F.col("own") == F.col("first.own"))
    return out.drop("times").withColumn("first", F.when(~me, F.col("first")))


def _page(page_id):
    return F.coalesce(page_id.cast("string"), F.lit(""))


def _name(kind: int, page_id, own, url, sha):
    """The record's URI: a UUID of what its capture holds and of its number among equal ones, whose first digits tell the kind of record."""
    d = F.md5(F.concat(_page(page_id), F.lit("-"), own.cast("string"), F.lit("-"), sha, F.lit("-"), url).cast("binary"))
    parts = [F.substring(d, a, n) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", F.lit(f"<urn:uuid:{kind:08x}"), *parts[:-1], F.concat(parts[-1], F.lit(">")))


def _record(kind, name, headers: list, body):
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name, F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\n"))
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    return F.concat(head, *lines, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body)


def _records_of(rows: DataFrame) -> DataFrame:
    """`value`: the three records of each capture."""
    rows = rows.withColumn("name", _name(1, *(F.col(c) for c in ("page_id", "own", "url", "sha"))))
    first, url, name = F.col("first"), F.col("url"), F.col("name")
    revisit = first.isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        name,
        [
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
            ("WARC-Profile", F.when(revisit, _SAME_PAYLOAD)),
            ("WARC-Refers-To", F.when(revisit, _name(1, *(first[c] for c in ("page_id", "own", "url", "sha"))))),
            ("WARC-Refers-To-Target-URI", first["url"]),
            ("X-Page", _page(F.col("page_id"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
    )
    request = _record(
        F.lit("request"),
        F.overlay(name, F.lit("2"), 18),
        [("WARC-Concurrent-To", name), ("WARC-Target-URI", url), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        F.lit("metadata"), F.overlay(name, F.lit("3"), 18), [("WARC-Concurrent-To", name), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"))
    )
    return rows.select(F.explode(F.array(response, request, metadata)).alias("value"))


def size_class(size):
    """0 for pages of up to SMALL_PAGE bytes, 1 for up to STEP times that, and so on."""
    return F.greatest(F.ceil(F.log(size / SMALL_PAGE) / F.log(F.lit(float(STEP)))), F.lit(0)).cast("int")


def write(pages: DataFrame, path: str) -> None:
    """gzip WARC files of the pages under path, in a folder for each class of size."""
    known = marks(pages)
    classes = sorted(r["of"] for r in known.select(size_class(F.col("bytes") + 1).alias("of")).distinct().collect())  # some eight at most
    size = F.octet_length(F.coalesce("html", F.lit("")))
    for k in classes or [0]:
        own = pages if len(classes) < 2 else pages.where(size_class(size + 1) == k)
        most = 3 * max(1, FILE_BYTES // (SMALL_PAGE * STEP**k))
        writer = _records_of(captures(own, known)).write.option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        writer.option("maxRecordsPerFile", most).text(f"{path}/{k}")


def parse(stream) -> Iterator[dict]:
    """Headers (lower-case names) and block (`body`) of each record in a stream of bytes."""
    while stream.readline():  # the version
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line[:-2].partition(b": ")
            head[k.decode().lower()] = v.decode(errors="replace")
        head["body"] = stream.read(int(head["content-length"]))
        stream.read(len(_END))
        yield head


def _records(batches: Iterator) -> Iterator:
    import base64
    import hashlib

    import pyarrow as pa

    names = ("record_id", "type", "concurrent_to", "refers_to", "target", "page", "header_digest", "bytes", "digest", "payload")
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list):
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for r in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                kind, body = r["warc-type"], r["body"]
                if kind in ("response", "revisit"):  # an HTTP message: the payload follows its head
                    payload, keep = memoryview(body)[body.index(b"\r\n\r\n") + 4 :], None
                else:
                    payload, keep = body, body
                    held += len(body)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((r["warc-record-id"], kind, r.get("warc-concurrent-to"), r.get("warc-refers-to"), r.get("warc-target-uri"), r.get("x-page"), r.get("warc-payload-digest"), len(payload), digest, keep))
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives; response payloads are digested, not kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    schema = "record_id string, type string, concurrent_to string, refers_to string, target string, page string, header_digest string, bytes long, digest string, payload binary"
    return files.mapInArrow(_records, schema)


def transactions(records: DataFrame) -> DataFrame:
    """One row a capture: capture (the response's record id), page_id, url, request, response, metadata (nested)."""
    response = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture"),
        F.when(F.col("page") != "", F.col("page").cast("long")).alias("page_id"),
        F.col("target").alias("url"),
        F.struct("type", "refers_to", "header_digest", "bytes", "digest").alias("response"),
    )

    def side(kind: str) -> DataFrame:
        return records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("capture"), F.struct("record_id", F.col("payload").cast("string").alias("payload")).alias(kind))

    return response.join(side("request"), "capture", "left").join(side("metadata"), "capture", "left")


def query(spark, sf_dir: str) -> DataFrame:
    path = C.scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captured = C.saved(transactions(C.saved(read(spark, path), "records")), "transactions")
    r = F.col("response")
    # what a revisit stands for: its response's payload
    wanted = captured.where(r["type"] == "revisit").select(r["refers_to"].alias("of")).distinct()
    stored = captured.where(r["type"] == "response").join(wanted, F.col("capture") == F.col("of")).select(
        "of", F.col("page_id").alias("of_page"), r["digest"].alias("of_digest"), r["bytes"].alias("of_bytes")
    )
    whole = captured.join(stored, (r["refers_to"] == F.col("of")) & (r["header_digest"] == F.concat(F.lit("sha1:"), F.col("of_digest"))), "left")
    visit = r["type"] == "revisit"
    return whole.select(
        "page_id",
        F.when(visit, F.col("of_bytes")).otherwise(r["bytes"]).alias("payload_bytes"),
        F.when(visit, F.col("of_digest")).otherwise(r["digest"]).alias("payload_digest"),
        r["type"].alias("record_type"),
        F.col("of_page").alias("refers_to"),
    )


_LETTERS = ", ".join(
    f"substr('{_ALPHABET}', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (SELECT page_id, payload_bytes, concat({_LETTERS}) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
