"""WARC archives without repeated payloads.

Headers are shuffled by payload digest, a payload of some length is stored once, by the record with the smallest id,
and the others become revisit records. Archives are text to Spark: a record is a line whose separator is the two line
ends that close a WARC record, so the writer's commit protocol, compression and file systems are Spark's own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import staged
from plantlens.session import scratch_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_RECORDS = 20_000
_PARSED = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def resolve(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(id, digest, first) of the revisits among ``headers`` (id, digest, bytes): first is the id of the stored record.

    Payloads below ``min_bytes`` are always stored. Rows without an id revisit any stored equal payload; if no equal
    row has an id, all are stored. Rows that repeat id and digest are decided alike, so one decision is returned.
    """
    long_ = headers.where(F.col("bytes") >= min_bytes)
    firsts = long_.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return long_.join(firsts, "digest").where("not id <=> first").select("id", "digest", "first").distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> None:
    """Writes one record per row under ``path``; null payloads are empty, null and unprintable addresses are left blank."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    headers = staged(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "headers")
    revisits = resolve(headers, min_bytes).select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first")
    rows = rows.join(revisits.hint("shuffle_hash"), F.expr("id <=> r_id and digest = r_digest"), "left")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))

    def urn(c: str):
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), urn("id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn("first"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)
    rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, compressed as a whole, by record, or not at all."""
    raw = io.BytesIO(content)
    file = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := file.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        yield head, block


def _number(urn: str) -> int | None:
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _PARSED.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in records(content.as_py()):
                kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").rpartition(":")[2]
                if kind not in ("response", "revisit"):
                    continue
                payload = block.partition(b"\r\n\r\n")[2]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {head.get('warc-record-id')} does not have its digest")
                rows.append((_number(head["warc-record-id"]), head.get("warc-target-uri"), kind, len(payload) if kind == "response" else None, digest,
                             _number(head["warc-refers-to"]) if kind == "revisit" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to) of every record under ``path``.

    Payloads are checked against their digests. A revisit gets the size of the response it refers to. A file is read
    whole by one task, so archives larger than 2 GB must be cut first; those written here hold 20,000 records at most.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = staged(files.mapInArrow(_parse, _PARSED), "records")
    stored = found.where("record_type = 'response'").select(F.col("id").alias("s_id"), F.col("payload_digest").alias("s_digest"), F.col("payload_bytes").alias("s_bytes")).distinct()
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(stored, F.expr("refers_to = s_id and payload_digest = s_digest"), "left")
    same = revisits.select("id", "url", "record_type", F.col("s_bytes").alias("payload_bytes"), "payload_digest", "refers_to")
    return found.where("record_type = 'response'").unionByName(same)


def deduplicated(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` as archives (to a folder in the shared one unless ``path`` is given) and reads them back.

    An empty table writes an empty archive and reads back no rows.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
