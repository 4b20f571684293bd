"""WARC: archives written by Spark's own writer, read back by Content-Length, and transactions assembled by concurrent-to ids.

A record is one string: its header block, a blank line, the content block. Records end in CRLF CRLF, which is the line separator
given to Spark's text writer, so its part files are WARC files (gzip members), committed like any table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, table

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # pages carry no date
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: eight groups of five hex digits become four base-32 digits each."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str | Column, rid: Column, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines: list[Column] = [F.lit(VERSION + CRLF)]
    for name, value in [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit("")))  # a null value leaves the header out
    return F.concat(*lines, F.lit(CRLF), block)


def _key_of(payload: Column) -> Column:
    return F.sha2(payload, 256)


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages with payload (null: empty), digest, the name of their capture (`cap`), and that of the capture that holds an equal
    payload of at least least_bytes bytes (`answered_by`): the row with the largest id of such a group answers, the others
    revisit it; smaller payloads all answer.

    A name is the page id, the hashes of payload and url, and the place among rows equal in all of these, so names are unique
    and a leader's is known to its revisits before anything is written.
    Only (hash, id, url hash) are aggregated; pages are joined with the rows of shared payloads alone, on both sides by plain
    exchanges, so a payload of a third of all rows is split by the adaptive skew join. Equal payloads with one largest id in
    several rows: each such row is a response. A null id never is the largest; among null ids alone every row answers."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", _key_of(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("url_key", F.sha2("url", 256))
    same = ["key", "page_id", "url_key"]
    each = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("times"), F.max("payload_bytes").alias("bytes"))
    groups = each.groupBy(F.col("key").alias("shared")).agg(F.max(F.struct("page_id", "url_key")).alias("lead"), F.sum("times").alias("n")).where("n > 1")
    leads = F.col("page_id").eqNullSafe(F.col("lead.page_id")) | (F.col("bytes") < least_bytes)
    facts = each.join(groups, F.col("key") == F.col("shared")).select(F.col("key").alias("f_key"), F.col("page_id").alias("f_page"), F.col("url_key").alias("f_url"), "times", F.when(~leads, F.col("lead")).alias("lead"))
    facts = cut(facts, "warc-facts")
    joined = rows.join(facts, (F.col("key") == F.col("f_key")) & F.col("page_id").eqNullSafe(F.col("f_page")) & (F.col("url_key") == F.col("f_url")), "left").drop("f_key", "f_page", "f_url")
    repeated = facts.where("times > 1")
    out = joined.where("times is null or times = 1").withColumn("row", F.lit(1).cast("bigint"))
    if not repeated.isEmpty():  # rows equal in all columns are counted and numbered; their payload is shuffled once for each
        again = joined.where("times > 1").groupBy(*same).agg(*[F.first(c).alias(c) for c in joined.columns if c not in same])
        out = out.unionByName(again.withColumn("row", F.explode(F.expr("sequence(1L, times)"))))
    name = lambda page, url, row: F.concat_ws(".", F.coalesce(page.cast("string"), F.lit("null")), F.substring("key", 1, 32), F.substring(url, 1, 16), row.cast("string"))
    digest = base32_sha1(F.col("payload").cast("binary"))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", digest.alias("digest"), name(F.col("page_id"), F.col("url_key"), F.col("row")).alias("cap"),
        F.col("lead.page_id").alias("refers_to"), F.when(F.col("lead").isNotNull(), name(F.col("lead.page_id"), F.col("lead.url_key"), F.lit(1))).alias("answered_by"),
    )


def volume_of(size: Column, most_bytes: int = 1 << 27) -> Column:
    """A number for each row such that rows of one task and volume hold about most_bytes at most, whatever their sizes: rows are
    classed by size up to a power of four of 16 KiB, and each class is cut after every most_bytes / (its largest size) rows of
    the task. A larger row has a volume of its own."""
    largest, place, out, past = 1 << 14, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), None, None
    while largest <= most_bytes:
        cls = F.lit(largest.bit_length()) * F.lit(1 << 40) + F.floor(place / (most_bytes // largest))
        out = F.when(size <= largest, cls) if out is None else out.when(size <= largest, cls)
        largest *= 4
    past = F.lit(largest.bit_length()) * F.lit(1 << 40) + place
    return (past if out is None else out.otherwise(past)).cast("bigint")


def write_archive(captures: DataFrame, path: str, most_bytes: int = 1 << 27) -> None:
    """Three records per capture: request, response or revisit (concurrent to the request), metadata (concurrent to the response).
    A revisit refers to the record that holds its payload. Files are bounded by bytes (see volume_of), a capture in one file."""
    rid = lambda kind, key: F.concat(F.lit(f"<urn:page:{kind}:"), key, F.lit(">"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    host = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)
    request = F.concat(F.lit("GET "), F.regexp_replace(target, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("answered_by").isNotNull()
    common = [("WARC-Target-URI", target)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), rid("answer", F.col("cap")),
        [*common, ("WARC-Concurrent-To", rid("request", F.col("cap"))), digest, ("X-Payload-Bytes", F.col("payload_bytes").cast("string")), ("X-Page-Id", F.col("page_id").cast("string")),
         ("WARC-Refers-To", rid("answer", F.col("answered_by"))), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", "application/http;msgtype=response")],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    meta = F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + "outlinks: "), F.expr("cast(regexp_count(payload, 'href=') as string)"), F.lit(CRLF))
    records = F.array(
        _record("request", rid("request", F.col("cap")), [*common, ("Content-Type", "application/http;msgtype=request")], request),
        answer,
        _record("metadata", rid("metadata", F.col("cap")), [*common, ("WARC-Concurrent-To", rid("answer", F.col("cap"))), ("Content-Type", "application/warc-fields")], meta),
    )
    held = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")) + 2 * F.octet_length("url") + 2048  # of the three records
    out = captures.withColumn("volume", volume_of(held, most_bytes)).select("volume", F.explode(records).alias("value"))
    out.write.partitionBy("volume").option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of a gzip (any number of members) or plain file, decompressed as they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.view, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.view):
            return False
        part = self.view[self.at : self.at + (1 << 18)]
        self.at += len(part)
        if self.zip is None:
            self.buffer += part
        else:
            self.buffer += self.zip.decompress(part)
            while self.zip.eof and self.zip.unused_data:
                rest = self.zip.unused_data
                self.zip = zlib.decompressobj(31)
                self.buffer += self.zip.decompress(rest)
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                return None
        out = bytes(self.buffer[:k])
        del self.buffer[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is cut short")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file; blocks are found by Content-Length, so they may hold any bytes."""
    s = _Stream(data)
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = s.take(int(headers["content-length"]))
        if s.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


RECORD = "record_type string, record_id string, concurrent_to string, refers_to_record string, target_uri string, payload_digest string, page_id bigint, declared_bytes bigint, payload_bytes bigint, computed_digest string, fields map<string,string>, payload binary"


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record, of files of a bounded size. A response's payload is its HTTP body, whose length and base32 SHA-1 are
    computed from the bytes read; a metadata record's fields come as a map."""
    import base64
    import hashlib

    kinds = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to_record", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("declared_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def row(h: dict[str, str], block: bytes) -> tuple:
        number = lambda v: None if v is None else int(v)
        kind, body, fields, size, digest = h["warc-type"], None, None, None, None
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2]
            size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif kind == "metadata":
            body, fields = block, {}
            for line in block.decode("utf-8", "replace").split("\r\n"):
                k, colon, v = line.partition(":")
                if colon:
                    fields[k.strip().lower()] = v.strip()
        declared = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        return (kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), declared, number(h.get("x-page-id")), number(h.get("x-payload-bytes")), size, digest, None if fields is None else list(fields.items()), body if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for h, block in parse_records(content.as_py()):
                    rows.append(row(h, block))
                    held += len(block) if with_payload else 200
                    if len(rows) >= 4096 or held > 1 << 24:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: an answer (response or revisit), the request it is concurrent to, the metadata records
    concurrent to it, and of a revisit the response it refers to. A capture without request, metadata or known response keeps
    null or an empty list; other records are not captures. `records` is read once for each role, so it should be a table."""
    answers = records.where(F.col("record_type").isin("response", "revisit"))
    requests = records.where("record_type = 'request'").select(F.col("record_id").alias("request_id"), F.struct("record_id", "target_uri").alias("request"))
    metadata = records.where("record_type = 'metadata'").groupBy(F.col("concurrent_to").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("record_id", F.map_entries("fields").alias("fields"), "payload"))).alias("metadata"))
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("held_id"), F.struct("record_id", "page_id").alias("refers_to"))
    joined = answers.join(requests, F.col("concurrent_to") == F.col("request_id"), "left").join(metadata, F.col("record_id") == F.col("answer_id"), "left")
    # Most answers refer to nothing: a key of their own keeps them out of one partition.
    joined = joined.join(held, F.coalesce("refers_to_record", F.concat(F.lit("none of "), F.col("record_id"))) == F.col("held_id"), "left")
    answer = F.struct("record_type", "record_id", "payload_digest", "computed_digest", "declared_bytes", F.col("payload_bytes"), "payload")
    none = F.array().cast("array<struct<record_id:string,fields:array<struct<key:string,value:string>>,payload:binary>>")
    return joined.select("page_id", "target_uri", answer.alias("answer"), "request", F.coalesce("metadata", none).alias("metadata"), "refers_to")


def archive_round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write pages as WARC into the shared folder, read the files back once, assemble the transactions.

    Null html is an empty payload, a null url an empty target, a null page_id stays null (see plan_captures). Repeated rows and
    ids each have a capture. No pages give no rows; other columns are not read."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archive(plan_captures(pages), path)
    return assemble(cut(read_archive(spark, path, with_payload), "warc-records"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and out of the nested rows the request's target and the metadata's outlinks."""
    got = archive_round_trip(table(spark, sf_dir, "pages"))
    links = F.filter(F.get(F.col("metadata.fields"), F.lit(0)), lambda f: f["key"] == "outlinks")
    return got.select(
        "page_id", F.coalesce("answer.payload_bytes", "answer.declared_bytes").alias("payload_bytes"), F.coalesce("answer.computed_digest", "answer.payload_digest").alias("payload_digest"),
        F.col("answer.record_type").alias("record_type"), F.col("refers_to.page_id").alias("refers_to"), F.col("request.target_uri").alias("request_uri"), F.get(links, F.lit(0))["value"].cast("bigint").alias("outlinks"),
    )


#: base32 of the digest in SQL, as in base32_sha1: five hex digits make four base-32 digits.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, coalesce(url, '') AS u FROM pages),
d AS (SELECT page_id, h, u, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS leader FROM p),
e AS (SELECT *, {ints} FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {chars} AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to,
  regexp_replace(u, '[\\x00-\\x20\\x7f]', '%20', 'g') AS request_uri, CAST(len(string_split(h, 'href=')) - 1 AS BIGINT) AS outlinks
FROM e
""".format(
    ints=", ".join(f"CAST('0x' || substr(hex, {5 * i + 1}, 5) AS BIGINT) AS v{i}" for i in range(8)),
    chars=" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v{i} >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)),
)
