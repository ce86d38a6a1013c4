"""WARC archives written, read back and assembled into captures.

``write_archives`` turns pages into request, response (or revisit) and metadata
records that name their response by ``WARC-Concurrent-To``; ``read_records``
parses archives record by record by their ``Content-Length``; ``captures``
brings the records of one transaction together and emits one nested row each.

Spark's text writer puts two line ends after each row, which is how WARC ends a
record, so the archives are written by Spark's own commit protocol, as gzip
files.  Read the other way round, the text reader yields what stands between
double line ends, one piece at a time, and records are put together from the
pieces by their length.  A task thus holds one record (and one Arrow batch),
however long its file.

Finding the first of equal payloads takes a join on payload digests, which
shuffles the payloads once (pages with one very common payload are split by
adaptive execution).  Everything else about a capture is in its own records.

Of records with one payload of at least ``least_bytes`` bytes the smallest
page id is the response, the others are revisits that refer to it.  Every row
is a capture with record ids of its own.  A revisit names its response's record
in ``WARC-Refers-To`` unless the response's row itself repeats; its metadata
record names the response's page in any case.

Defined results: null html is an empty payload; a row with a null page id is
never the one referred to: it revisits the response of its payload, and is a
response itself where no row with an id has that payload; rows that repeat give as many
captures, all of them responses where their page id is the smallest; line ends
and spaces inside a url are percent-encoded in headers; a record that is cut
off or whose digest is wrong raises ``ValueError``, and so does an archive
without gzip that is so long that Spark would split it; columns other than
``page_id``, ``url`` and ``html`` are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import shared_dir

FILE_ROWS = 5000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def capture_key(page_id: object, url: str | None, payload: bytes, place: tuple[int, int] | None = None) -> str:
    """Without a place (task, row) the same for equal rows, so that another row's record can be referred to unmet."""
    seed = repr((page_id, url, place)).encode() + hashlib.sha1(payload).digest()
    return hashlib.sha1(seed).hexdigest()[:32]


def record_id(key: str, role: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hex=hashlib.md5(f'{key}{role}'.encode()).hexdigest())}>"


def record(kind: str, ident: str, block: bytes, content_type: str, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), *more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def transaction(page_id: object, url: str | None, payload: bytes, first: tuple[object, str | None, bool] | None, place: tuple[int, int] | None = None) -> bytes:
    """The records of one page; first: (page id, url, has it one row only) of the response that it revisits."""
    uri = quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._")
    key = capture_key(page_id, url, payload, place)
    digest, main = f"sha1:{base32_sha1(payload)}", record_id(key, 0)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    if first is None:
        answer = record("response", main, http + payload, "application/http;msgtype=response", *about)
    else:
        refers = [("WARC-Refers-To", record_id(capture_key(first[0], first[1], payload), 0))] if first[2] else []
        refers.append(("WARC-Refers-To-Target-URI", quote(first[1] or "", safe="%/:?#[]@!$&'()*+,;=~-._")))
        answer = record("revisit", main, http, "application/http;msgtype=response", *about, *refers, ("WARC-Profile", PROFILE))
    asked = f"GET {uri or '/'} HTTP/1.1\r\nUser-Agent: sievework\r\n\r\n".encode()
    said = {"page-id": page_id, "url": None if url is None else quote(url, safe=""), "refers-to-page": first and first[0]}
    fields = "".join(f"{k}: {v}\r\n" for k, v in said.items() if v is not None).encode()
    linked = [("WARC-Concurrent-To", main), ("WARC-Target-URI", uri)]
    request = record("request", record_id(key, 1), asked, "application/http;msgtype=request", *linked)
    metadata = record("metadata", record_id(key, 2), fields, "application/warc-fields", *linked)
    return END.encode().join((request, answer, metadata))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one transaction per row of (page_id, url, html) under ``path``."""
    read = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    read = read.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    rows = read.groupBy("digest", "size", "page_id", "url").agg(F.count("*").alias("rows"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "rows"))
    first = rows.groupBy("digest", "size").agg(F.min(named).alias("first"), F.sum("rows").alias("n")).where((F.col("n") > 1) & (F.col("size") >= least_bytes))
    first = first.select("digest", "size", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), (F.col("first.rows") == 1).alias("single"))
    flagged = read.join(first, ["digest", "size"], "left").select("page_id", "url", "html", "first_id", "first_url", "single")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, out = batch.slice(at, 500), []
                rest = (some.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
                for page_id, url, first_id, first_url, single, html in zip(*rest, some.column(2).cast(pa.large_binary()), strict=True):
                    n += 1
                    first = (first_id, first_url, single) if first_id is not None and page_id != first_id else None
                    referred = single and page_id == first_id and url == first_url
                    out.append(transaction(page_id, url, html.as_py(), first, None if referred else (task, n)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    records = flagged.mapInArrow(run, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of one archive, given as what stands between double line ends."""
    end, head, size, held, total = END.encode(), None, 0, [], 0
    for piece in pieces:
        if head is not None and held:
            held.append(end)
            total += len(end)
            if total >= size:  # the block ends within these line ends
                yield head, b"".join(held)[:size]
                head = None
        if head is not None:
            held.append(piece)
            total += len(piece)
            if total >= size:
                block = b"".join(held)
                if block[size:].strip(b"\r\n"):
                    raise ValueError("a block is longer than its header says")
                yield head, block[:size]
                head = None
            continue
        piece = piece.lstrip(b"\r\n")
        if not piece:
            continue
        if not piece.startswith(b"WARC/"):
            raise ValueError(f"no record at {piece[:40]!r}")
        head, held, total = {}, [], 0
        for line in piece.decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        if not size:
            yield head, b""
            head = None
    if head is not None:
        if not held or total + len(end) < size:
            raise ValueError("a block is cut off")
        yield head, b"".join([*held, end])[:size]


RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; response digests are tested against their payload."""
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind, payload, size, digest, fields = head["warc-type"], None, None, None, {}
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            status, *rest = http.decode("latin-1").split("\r\n")
            fields = {"status": status.split(" ", 2)[1]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
            size = int(fields.get("content-length", 0))
            if kind == "response":
                size, payload = len(body), body
                if digest and digest != base32_sha1(body):
                    raise ValueError(f"digest of {head['warc-record-id']}")
        elif kind == "request":
            fields = {"request": block.split(b"\r\n", 1)[0].decode()}
        elif kind == "metadata":
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)}
        keys = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date")
        return *(head.get(k) for k in keys), size, digest, list(fields.items()), payload if with_payload else None

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for file, whole, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not whole:
                    raise ValueError("an archive without gzip that is split among tasks")
                yield file, value.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, own in groupby(pieces(batches), key=lambda x: x[0]):  # a file's pieces come one after the other, in order
            for head, block in parse(x for _, x in own):
                rows.append(row(head, block))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    read = spark.read.option("lineSep", END).option("pathGlobFilter", "[!._]*").text(path)
    at = F.col("_metadata")
    whole = at["file_block_length"] == at["file_size"]
    return read.select(F.xxhash64(at["file_path"]).alias("file"), whole.alias("whole"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata, met by concurrent-to identifiers."""
    main = F.col("type").isin("response", "revisit")
    part = F.struct("record_id", "type", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "fields", "payload")
    small = F.struct("record_id", "date", "fields")
    met = records.where(main | F.col("type").isin("request", "metadata")).groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"))
    return met.agg(
        F.first(F.when(main, part), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("type") == "request", small), ignorenulls=True).alias("request"),
        F.first(F.when(F.col("type") == "metadata", small), ignorenulls=True).alias("metadata"),
    )


def pages_of(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to) of captures; refers_to is a page id."""
    fields, response = F.col("metadata.fields"), F.col("response")
    return found.select(
        fields["page-id"].cast(id_type).alias("page_id"), F.url_decode(F.replace(fields["url"], F.lit("+"), F.lit("%2B"))).alias("url"), response["type"].alias("record_type"),
        response["payload_bytes"].alias("payload_bytes"), response["payload_digest"].alias("payload_digest"), fields["refers-to-page"].cast(id_type).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder (or ``path``), read them back: one row per capture."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    return pages_of(captures(read_records(spark, path, with_payload=False)), pages.schema["page_id"].dataType.simpleString())
