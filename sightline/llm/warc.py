"""WARC archives: records of captures written, read back, and assembled into one row per capture.

A capture is a response (or a revisit of an earlier response with the same payload), a request and
a metadata record, tied together by concurrent-to identifiers. A record ends in the two line ends
that separate records, so Spark's text writer with that separator writes archives, committed task
by task like any table; compressed files are read as a whole by one task, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are stored again each time.
LEAST_SHARED = 100

RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "block binary, payload_bytes bigint, payload_digest string, declared_digest string, fields map<string,string>"
)


def _record_id(kind: str, *parts: Column) -> Column:
    """A name-based identifier: equal rows have equal ones."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; a null value leaves it out. Line ends inside a value are escaped."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), clean, F.lit(END))).otherwise("")


def _record(kind: Column, record_id: Column, headers: list[Column], content: str, block: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1" + END), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id),
        _header("WARC-Date", F.lit(DATE)), *headers, _header("Content-Type", F.lit(content)),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block,
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", per_archive: int = 2000) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of `pages`.

    Of rows with equal payloads of at least LEAST_SHARED bytes that of the least key is the
    response and all others revisit it; rows that share the least key are all responses. A null
    payload is empty, a null url has no target header, a null key sorts first.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body")).withColumns(
        {"size": F.octet_length("body").cast("bigint"), "digest": F.sha2("body", 256)}
    )
    firsts = (
        rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest")
        .agg(F.min(F.struct("key", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    rows = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first.key").eqNullSafe(F.col("key"))
    own = _record_id("response", F.col("key"), F.col("digest"), F.col("url"))
    first = _record_id("response", F.col("first.key"), F.col("digest"), F.col("first.url"))
    uri = _header("WARC-Target-URI", F.col("url"))
    host = F.regexp_extract(F.col("url"), r"://([^/?#]*)", 1)
    path_of = F.regexp_extract(F.col("url"), r"://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(BREAK))
    answer = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("size").cast("string"), F.lit(BREAK), F.when(again, "").otherwise(F.col("body")),
    )
    note = F.concat(_header("page-id", F.col("key").cast("string")), _header("payload-bytes", F.col("size").cast("string")))
    concurrent = _header("WARC-Concurrent-To", own)
    request = _record(F.lit("request"), _record_id("request", F.col("key"), F.col("digest"), F.col("url")), [uri, concurrent], "application/http;msgtype=request", F.coalesce(ask, F.lit("")))
    response = _record(
        F.when(again, "revisit").otherwise("response"), own,
        [uri, _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         _header("WARC-Profile", F.when(again, REVISIT_PROFILE)), _header("WARC-Refers-To", F.when(again, first))],
        "application/http;msgtype=response", answer,
    )
    metadata = _record(F.lit("metadata"), _record_id("metadata", F.col("key"), F.col("digest"), F.col("url")), [uri, concurrent], "application/warc-fields", note)
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    (
        records.write.option("lineSep", BREAK).option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * per_archive).text(path)
    )


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(END)
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if v}


def _parse(chunks: Iterator[bytes | None]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; chunks are what stands between record separators.

    Blocks may hold or end in parts of a separator, so the chunks are put together again and cut
    by Content-Length. Line ends between records are skipped: the reader adds a separator to an
    archive's last chunk.
    """
    separator, parts, size, head, need = BREAK.encode(), [], 0, None, 0
    for chunk in chunks:
        parts += (chunk or b"", separator)
        size += len(parts[-2]) + len(separator)
        while size >= need:
            held = b"".join(parts)
            if head is None:
                held = held.lstrip(b"\r\n")
                parts, size = [held], len(held)
                if not held:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError(f"no record starts with {held[:40]!r}")
                raw, found, rest = held.partition(separator)
                if not found:
                    break
                head = _headers(raw)
                need = int(head["content-length"]) + len(separator)
                parts, size = [rest], len(rest)
                continue
            if held[need - len(separator) : need] != separator:
                raise ValueError(f"record {head.get('warc-record-id')} does not fit its Content-Length")
            yield head, held[: need - len(separator)]
            parts, size, head, need = [held[need:]], size - need, None, 0
    if head is not None or b"".join(parts).strip(b"\r\n"):
        raise ValueError("an archive ends inside a record")


def read_archives(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row per record (see RECORD). The payload of a response is what follows its HTTP headers;
    its bytes and digest are taken from the block itself. Without `with_block` blocks stay behind.
    An archive that ends inside a record, or whose lengths don't fit, fails the job."""
    chunks = spark.read.option("lineSep", BREAK).text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "block", "payload_bytes", "payload_digest", "declared_digest", "fields"]
        kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, held = [], 0
        for head, block in _parse(c.as_py() for part in batches for c in part.column(0)):
            kind = head.get("warc-type")
            size = digest = fields = None
            if kind in ("response", "revisit"):
                payload = block.partition(BREAK.encode())[2]
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            elif kind == "metadata":
                fields = list(_headers(END.encode() + block).items())
            rows.append((
                head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
                block if with_block else None, size, digest, (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None, fields,
            ))
            held += len(block)
            if len(rows) >= 2000 or held > 8_000_000:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    return chunks.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, response, request, metadata).

    Requests and metadata name their response in concurrent_to; where several do, the one of the
    least record_id counts; where none does, the struct is null. Requests and metadata without a
    response are dropped, as there is no capture.
    """
    def partner(kind: str) -> DataFrame:
        some = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        whole = F.struct("record_id", "target_uri", "block", "fields")
        return some.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(whole, "record_id").alias(kind))

    response = records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id", F.struct("record_type", "target_uri", "refers_to", "block", "payload_bytes", "payload_digest", "declared_digest").alias("response")
    )
    return response.join(partner("request"), "record_id", "left").join(partner("metadata"), "record_id", "left")


def resolve(captures: DataFrame) -> DataFrame:
    """`captures` with `origin`, the capture that a revisit refers to (null for responses and where
    the archives don't hold it): record_id, page_id, payload_bytes, payload_digest, block."""
    origin = captures.where("response.record_type = 'response'").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("_origin"),
        F.struct(
            "record_id", F.expr("try_cast(metadata.fields['page-id'] AS bigint)").alias("page_id"),
            "response.payload_bytes", "response.payload_digest", "response.block",
        ).alias("origin"),
    )
    refers = F.col("response.refers_to")
    found = captures.where(refers.isNotNull()).join(origin, refers == F.col("_origin"), "left").drop("_origin")
    # responses refer to nothing; under one null key they would meet in one task
    return found.unionByName(captures.where(refers.isNull()).withColumn("origin", F.lit(None).cast(found.schema["origin"].dataType)))
