"""WARC archives and the external merge of their capture index.

Archives are written by Spark's text writer: a record is a row whose text ends
in the record separator, so every part file is a (gzipped) WARC file, wherever
the session's file system is. They are read back as whole files and parsed by
Content-Length.

Which page is a revisit is found from ids, digests and sizes alone. Payloads
are shuffled once, by a hash of page and digest, into archives of about
``FILE_BYTES`` of payload: no digest, URL or id gathers rows there.

Each archive file gives one capture run, sorted by URL key and time. Runs are
cut at the bounds of many small ranges of the global order, about
``RANGE_ROWS`` captures each, by a range key that no two captures share; so a
URL or host with a third of all captures spans as many ranges as it needs. A
task takes a range's segments, which arrive run by run in order (sorted on
disk where they don't fit), and merges them by a loser tree. It holds one range
as Arrow columns, and no payload. Histories come out in global order: range by
range, and in order within each.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import shared_path, stored

#: Payloads below this are never revisits.
MIN_REVISIT = 1000
#: Records of an archive file at most.
FILE_RECORDS = 20_000
#: Payload bytes of an archive file, on average.
FILE_BYTES = 32 << 20
#: Captures of a range, about.
RANGE_ROWS = 1 << 17
#: Places that the pages without an id are dealt to, for each digest.
_SALTS = 64
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN_SCHEMA = "run long, at long, url_key string, captured_at string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ORDER = ["url_key", "captured_at", "page_id"]
#: No two captures agree in all of these.
_UNIQUE = [*_ORDER, "run", "at"]


def with_roles(pages: DataFrame, id: str, url: str, body: str, captured_at: Column, files: int, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, captured_at, payload, digest, size, refers_to (null: a response), dealt to ``files`` partitions."""
    own = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), captured_at.cast("timestamp").alias("captured_at"),
        F.coalesce(F.col(body).cast("string"), F.lit("")).alias("payload"),
    )
    own = own.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large = own.where(F.col("size") >= min_revisit).select("page_id", "digest")
    first = large.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    revisits = large.join(first, large.digest == first.of).where(~F.col("page_id").eqNullSafe(F.col("last")))
    # Pages without an id may be many and alike.
    salts = lambda n: F.when(F.col("page_id").isNull(), n).otherwise(F.lit(0))
    place = F.xxhash64("page_id", "digest", "salt")
    dealt = revisits.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.lit(_SALTS - 1)))))
    roles = stored(dealt.groupBy(place.alias("r_place")).agg(F.collect_set(F.struct("page_id", "digest", "last")).alias("said")), "revisits")
    own = own.withColumn("salt", salts(F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")))
    own = own.withColumn("place", place).repartition(files, "place")
    # The join is on the partitioning that cuts the archives; where the roles are few they are broadcast by their file size.
    joined = own.join(roles, own.place == roles.r_place, "left")
    mine = F.filter("said", lambda x: x["page_id"].eqNullSafe(F.col("page_id")) & (x["digest"] == F.col("digest")))
    joined = joined.withColumn("last", F.get(mine, F.lit(0))["last"])
    return joined.select("page_id", "url", "captured_at", "payload", "digest", "size", F.col("last").alias("refers_to"))


def record(page: dict[str, Column]) -> Column:
    """A WARC record without its closing separator."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = page["refers_to"].isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), page["size"], F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, page["payload"]))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(page["page_id"]),
        F.when(page["url"].isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), clean(page["url"]))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Date: "), F.coalesce(F.date_format(page["captured_at"], "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(page["refers_to"]))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), page["digest"],
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END), block,
    )


def archive_files(spark: SparkSession, payload_bytes: int) -> int:
    """Files of about FILE_BYTES of payload, or so many that all cores write."""
    return max(-(-payload_bytes // FILE_BYTES), 2 * spark.sparkContext.defaultParallelism)


def write_archives(roles: DataFrame, path: str) -> None:
    """Writes a record per row of ``with_roles`` below ``path``, a file or more for each partition."""
    text = roles.select(record({c: F.col(c) for c in roles.columns}).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query, in lower case up to the path."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + rest


def _page_of(name: str | None) -> int | None:
    value = name[len("<urn:page:") : -1] if name else "null"
    return None if value == "null" else int(value)


def parse_records(data):
    """(headers, block) of each record in an iterable of byte strings; holds one record at a time."""
    held, chunks, done = bytearray(), iter(data), False
    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and not done:
            more = next(chunks, None)
            done = more is None
            held += more or b""
        if at < 0:
            if bytes(held).strip():
                raise ValueError("a record without a head")
            return
        first, *lines = held[:at].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        while len(held) < at + 4 + size + 4 and not done:
            more = next(chunks, None)
            done = more is None
            held += more or b""
        if len(held) < at + 4 + size:
            raise ValueError("a record is cut off")
        yield head, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size + 4]


def _inflated(content: memoryview, step: int = 1 << 20):
    inflate = zlib.decompressobj(31)
    for a in range(0, len(content), step):
        block = bytes(content[a : a + step])
        while block:
            yield inflate.decompress(block)
            block = inflate.unused_data
            if inflate.eof and block:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def _entry(head: dict, block: bytes, with_payload: bool) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    claimed, revisit = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != claimed:
        raise ValueError("a payload and its digest differ")
    size = len(payload)
    if revisit:
        size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    url = head.get("warc-target-uri")
    return {"url_key": url_key(url), "captured_at": head["warc-date"], "page_id": _page_of(head["warc-record-id"]), "url": url, "record_type": head["warc-type"], "refers_to": _page_of(head.get("warc-refers-to")), "payload_bytes": size, "payload_digest": claimed, "payload": payload if with_payload and not revisit else None}


def sort_key(row: dict) -> tuple:
    return row["url_key"], row["captured_at"], row["page_id"] is not None, row["page_id"] or 0


def _parsing(with_payload: bool):
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RUN_SCHEMA.split(", "))])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                records = enumerate(parse_records(_inflated(memoryview(content.as_buffer()))))
                own = sorted(({"at": i, **_entry(h, b, with_payload)} for i, (h, b) in records), key=sort_key)
                name = int.from_bytes(hashlib.sha1(path.as_py().encode()).digest()[:7])
                step = 1000 if with_payload else 20_000
                for a in range(0, len(own), step):
                    yield pa.RecordBatch.from_pylist([{"run": name, **x} for x in own[a : a + step]], schema=schema)

    return run


def read_runs(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The capture runs of all archives below ``path``, each sorted by URL key, time and id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_parsing(with_payload), RUN_SCHEMA)


class LoserTree:
    """Merges sorted sequences of (key, value); a node keeps the loser of its match."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, build=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x[0], a) < (y[0], b)

    def _play(self, i: int, build: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            if build and self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and (head := self.heads[at := self.tree[0]]) is not None:
            yield head
            self.heads[at] = next(self.runs[at], None)
            self._play(at)


_MERGED = RUN_SCHEMA.removesuffix(", payload binary") + ", capture_seq long"
_STEP = 1 << 14


def merged_order(table: pa.Table) -> np.ndarray:
    """Places of the rows of sorted runs, one after the other, in the order that a loser tree gives."""
    run = table.column("run").to_numpy()
    starts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    keys, times, ids = (table.column(c) for c in _ORDER)

    def segment(lo: int, hi: int):
        for a in range(lo, hi, _STEP):
            part = [c.slice(a, min(_STEP, hi - a)).to_pylist() for c in (keys, times, ids)]
            yield from (((k, t, i is not None, i or 0), a + n) for n, (k, t, i) in enumerate(zip(*part, strict=True)))

    return np.fromiter((at for _, at in LoserTree([segment(*x) for x in zip(starts[:-1], starts[1:], strict=True)])), np.int64)


def _merging(batches):
    part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    order = merged_order(table)
    for a in range(0, len(order), _STEP):
        out = table.take(pa.array(order[a : a + _STEP])).append_column("capture_seq", pa.array((part << 40) + np.arange(a, min(a + _STEP, len(order)))))
        yield from out.to_batches()


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered capture histories: the runs' rows without payloads, and ``capture_seq``, which rises along the order."""
    ranges = max(-(-runs.count() // range_rows), runs.sparkSession.sparkContext.defaultParallelism)
    dealt = runs.drop("payload").repartitionByRange(ranges, *_UNIQUE).sortWithinPartitions("run", *_ORDER, "at")
    return dealt.mapInArrow(_merging, _MERGED)


def archive_and_index(
    pages: DataFrame, captured_at: Column, id: str = "page_id", url: str = "url", body: str = "html", min_revisit: int = MIN_REVISIT, path: str | None = None,
) -> DataFrame:
    """Writes all pages to archives, reads them back and merges their index.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url_key, captured_at, capture_seq. Of equal payloads
    of at least ``min_revisit`` bytes that with the largest id is the response
    and the others are revisits of it; rows that share this largest id are all
    responses. A null body is an empty payload, a null URL has the empty key, a
    null time is the epoch. A null id is never referred to: such pages revisit
    one with an id, and are responses where there is none. Further columns are
    ignored; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    payload_bytes = pages.agg(F.sum(F.octet_length(F.col(body).cast("string")))).first()[0] or 0
    write_archives(with_roles(pages, id, url, body, captured_at, archive_files(spark, payload_bytes), min_revisit), path)
    return merge_runs(stored(read_runs(spark, path), "runs")).drop("run", "at", "url")


#: DuckDB's form of ``op1``'s columns.
SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), l AS (
  SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest HAVING count(*) > 1
), r AS (
  SELECT p.*, CASE WHEN p.payload_bytes >= {MIN_REVISIT} AND p.page_id IS DISTINCT FROM l.last THEN l.last END AS refers_to
  FROM p LEFT JOIN l ON p.payload_digest = l.payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
