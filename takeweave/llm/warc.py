"""Deterministic sharded WARC archives of pages, and their reader.

Pages are dealt to shards by ranges of page_id whose bounds follow from exact payload bytes, not from samples: the ids are cut
into ``BUCKETS`` equal ranges, the bytes of each are summed, and a new shard begins whenever ``shard_bytes`` are full. A range with
more than that (a dense run of ids, one id or the null id on very many pages) is cut again, by id, or by digest where it is one id.
Each shard is sorted and written with one gzip member a record, a new file beginning when the current one has reached
``roll_bytes`` of compressed data. Shards, not tasks, name the files, so the same table gives the same files and bytes however it is
partitioned. Files are written under temporary names and renamed when whole; the manifest table, written last, lists the files
that are valid. Headers and digests are generated anew, and record ids and dates follow from the data alone, so a second attempt of
a task writes the same bytes.

Of the pages with equal payloads (html in UTF-8) of at least ``min_revisit_bytes`` bytes, the one with the least page_id
is a response and the others revisit it; smaller payloads are all responses. The least page_id of a payload comes from
an aggregate with map-side combining, and only payloads that occur more than once are joined back.

Null html is empty, a null url an empty URI. Pages with a null page_id sort first, carry no Page-Id header, and revisit
like the rest; payloads that occur only on such pages are responses. Rows that repeat a page_id are records of their own, in the
order of digest and url. A payload is one record, however long. Columns of the input beside page_id, url and html are not read.
An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeweave.llm.tokenfile import open_store
from takeweave.session import written

ROLL_BYTES = 64 << 20
#: Least payload bytes of a shard; a corpus of more than ``MOST_SHARDS`` such shards gets larger ones.
SHARD_BYTES = 16 << 20
MOST_SHARDS = 1 << 16
BUCKETS = 1 << 12
SUB = 256
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, first_page long, last_page long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CRLF = b"\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _uri(url: str) -> str:
    return "".join(url.split())


def _member(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))])
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + _CRLF + block + _CRLF + _CRLF) + z.flush()


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    digest, url = sha1_base32(payload), _uri(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + _CRLF + _CRLF
    fields = [("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if refers_to is None:
        return _member("response", fields, http + payload)
    first = _uri(refers_url or "")
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, first, digest)), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-Id", str(refers_to))]
    return _member("revisit", fields, http)


class _Roller:
    """Files of one shard."""

    def __init__(self, path: str, shard: str, roll_bytes: int):
        self.store, self.top = open_store(path)
        self.shard, self.roll_bytes, self.number, self.out = shard, roll_bytes, 0, None
        self.rows: list[tuple] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard}-{self.number:05d}.warc.gz"
            self.temp = f"{self.top}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temp, compression=None)
            info = f"software: takeweave\r\nformat: WARC File Format 1.1\r\nshard: {self.shard}\r\nfile: {self.number}\r\n".encode()
            head = _member("warcinfo", [("WARC-Record-ID", record_id(None, self.name, "")), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info)
            self.out.write(head)
            self.size, self.records, self.first = len(head), 0, page_id
        self.out.write(record)
        self.size += len(record)
        self.records += 1
        self.last = page_id
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.top}/{self.name}")
            self.rows.append((self.name, self.records, self.size, self.first, self.last))
            self.number, self.out = self.number + 1, None


def _write_task(path: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, shard, rows = None, None, []
        held = (None, None, None, None)  # page_id, digest, refers_to and its url of the last reference row
        for batch in batches:
            cols = [batch.column(k) for k in range(8)]
            for k in range(batch.num_rows):
                s1, s2, page_id, digest, kind, url, html, refers = (c[k].as_py() for c in cols)
                if (s1, s2) != shard:
                    if roller:
                        roller.close()
                        rows += roller.rows
                    shard, roller = (s1, s2), _Roller(path, f"{s1:06d}-{s2:06d}", roll_bytes)
                if kind == 0:
                    held = (page_id, digest, refers, url)
                    continue
                first, first_url = held[2:] if held[:2] == (page_id, digest) else (None, None)
                roller.add(page_id, page_record(page_id, url, html.encode("utf-8", "surrogatepass"), first, first_url))
        if roller:
            roller.close()
            rows += roller.rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)], names=["file", "records", "bytes", "first_page", "last_page"])

    return run


def _bucket(lo: int, width: int) -> Column:
    """Range of a page_id, -1 for null."""
    return F.when(F.col("page_id").isNull(), -1).otherwise(F.call_function("div", F.col("page_id").cast("decimal(20,0)") - F.lit(lo), F.lit(width).cast("decimal(20,0)"))).cast("long")


def _sub_bucket(lo: int, width: int) -> Column:
    """Place inside a range: by page_id, or by digest where the range is one id."""
    if width == 1:
        by_id = F.lit(None).cast("int")
    else:
        place = F.pmod(F.col("page_id").cast("decimal(20,0)") - F.lit(lo), F.lit(width).cast("decimal(20,0)"))
        by_id = F.call_function("div", place, F.lit(-(-width // SUB)).cast("decimal(20,0)")).cast("int")
    return F.coalesce(by_id, F.conv(F.substring("digest", 1, 2), 16, 10).cast("int"))


def shard_bounds(keys: DataFrame, shard_bytes: int | None = None) -> tuple[DataFrame, int, int, int]:
    """(b, s1, subs) for each range b of page ids, the least page_id, the width of a range, and about how many shards there are.

    s1 numbers the shards; a range of more than ``shard_bytes`` has the shards (s1, 1), (s1, 2), ... instead of (s1, 0), and ``subs``
    tells which one each of its ``SUB`` parts goes to. The table has at most ``BUCKETS`` + 1 rows of ``SUB`` entries at most.
    """
    lo, hi, total = keys.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).first()
    lo, hi = lo or 0, hi or 0
    width = -(-(hi - lo + 1) // BUCKETS)
    full = shard_bytes or max(SHARD_BYTES, -(-(total or 0) // MOST_SHARDS))
    fine = keys.groupBy(_bucket(lo, width).alias("b"), _sub_bucket(lo, width).alias("u")).agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = fine.withColumn("_part", (F.lit(1) + F.call_function("div", before(Window.partitionBy("b").orderBy("u")), F.lit(full))).cast("int"))
    coarse = fine.groupBy("b").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("u", "_part"))).alias("subs"))
    # One row a range: the prefix sum over all of them is one small task.
    coarse = coarse.withColumn("s1", F.call_function("div", before(Window.orderBy("b")), F.lit(full)).cast("long"))
    return coarse.select("b", "s1", F.when(F.col("n") > full, F.col("subs")).alias("subs")), lo, width, (total or 0) // full + 1


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES, shards: int | None = None, shard_bytes: int | None = None) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files below ``path`` and their list as ``path/_manifest``.

    ``shards`` is the number of tasks that write; it has no influence on the files.
    """
    store, top = open_store(path)
    store.create_dir(top, recursive=True)
    text = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    )
    keyed = text.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = written(keyed.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("n")), "warc-keys")
    repeated = keys.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    repeated = repeated.where("n > 1 and first is not null").select("digest", "first")
    far = F.coalesce(F.col("page_id") != F.col("first.page_id"), F.lit(True))
    revisits = keys.select("page_id", "digest").join(repeated, "digest").where(far)
    # Reference rows (kind 0) travel with the pages and stand right before those they concern, so the payloads move once.
    refs = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.col("first.url").alias("url"), F.lit(None).cast("string").alias("html"), F.col("first.page_id").alias("refers_to")).distinct()
    rows = keyed.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")).union(refs)
    bounds, lo, width, about = shard_bounds(keys, shard_bytes)
    bounds = written(bounds, "warc-bounds")
    placed = rows.withColumn("b", _bucket(lo, width)).join(F.broadcast(bounds), "b")  # at most BUCKETS + 1 rows
    s2 = F.when(F.col("subs").isNull(), 0).otherwise(F.try_element_at("subs", _sub_bucket(lo, width))).cast("long")
    placed = placed.select("s1", s2.alias("s2"), "page_id", "digest", "kind", "url", "html", "refers_to")
    n = shards or about  # one shard a task, however large the corpus
    ordered = placed.repartitionById(n, F.pmod(F.col("s1") + F.col("s2"), F.lit(n)).cast("int")).sortWithinPartitions("s1", "s2", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
    ordered.mapInArrow(_write_task(path, roll_bytes), MANIFEST).write.parquet(f"{path}/_manifest")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a gzip member stream."""
    raw, z, data = b"", None, []
    while True:
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                break
        if z is None:
            z = zlib.decompressobj(31)
        data.append(z.decompress(raw))
        raw = b""
        if z.eof:
            raw, z = z.unused_data, None
            record, data = b"".join(data), []
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            block = rest[: int(fields["content-length"])]
            if fields.get("warc-block-digest") != f"sha1:{sha1_base32(block)}":
                raise ValueError("a block does not have its digest")
            yield fields, block
    if z is not None:
        raise ValueError("truncated WARC file")


def _read_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for fields, block in parse_records(stream):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
                            raise ValueError("a payload does not have its digest")
                        page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
                        rows.append((None if page is None else int(page), length, digest, kind, None if refers is None else int(refers)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per page record of the files in the manifest: page_id, payload_bytes, payload_digest, record_type, refers_to. Digests are checked."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").select("file")
    n = max(1, files.count())
    return files.repartition(min(n, 100_000), "file").mapInArrow(_read_task(path), READ)


ORACLE = """
WITH k AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM k),
g AS (SELECT *, list_transform(range(0, 160, 40), lambda i: CAST('0x' || substr(hex, CAST(i // 4 + 1 AS BIGINT), 10) AS BIGINT)) AS parts FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform(range(35, -5, -5), lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
