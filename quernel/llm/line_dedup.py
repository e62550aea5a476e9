"""Line deduplication with a sharded minimal perfect hash.

Pass 1 counts, for each distinct line key, the documents that hold it. The
keys found in enough documents are indexed per shard by a minimal perfect
hash, whose slots hold a 64-bit fingerprint, the (saturated) document count
and the document that keeps the line. Pass 2 probes those arrays from the
documents: lines are never joined or shuffled.

Keys are 128-bit hashes (XXH3). 64 bits place a key, the other 64 are its
fingerprint, so a line that was not indexed is told apart.

Skew: a key's state is its largest ``min_docs`` document ids. Each task keeps
no more than that per key before the shuffle, so a line that every document
holds arrives as a few rows from each task. Shards are as many as the input is
large (``SHARD_BYTES``).

Index size: while all shards together fit ``broadcast_bytes`` (a measured sum,
checked at run time) the documents probe a broadcast copy and nothing else
moves. Up to ``PASSES`` times that, groups of shards that fit are broadcast one
after the other, and the documents pass by each: they are rewritten between,
but not shuffled. Beyond that a rewrite for each group would cost more than one
shuffle: documents send (hash, doc_id) probes to the shards, a shard with more
than its share of probes is copied to several tasks, the keys to drop come back
by id, and the documents are shuffled once by their id to meet them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import SPACE_CHARS, SPACE_CLASS, release, stored

#: Least code points of a key, and least documents that must hold it.
MIN_CHARS = 20
MIN_DOCS = 3
#: Most bytes of index that are broadcast at once.
BROADCAST_BYTES = 48 << 20
#: Groups of shards that the documents pass by; more are joined instead.
PASSES = 6
#: Input of a shard, as Spark estimates it (compressed files), and most shards.
SHARD_BYTES, SHARDS = 16 << 20, 1 << 16
#: Entries that a task gathers before it sorts and trims them.
_GATHER = 1 << 20
_SPACE = SPACE_CHARS.encode()
_M = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None where it is too short."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = (h ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) * _M
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit values, by cascading bit arrays.

    On each level a key alone in its position sets a bit; the others go to the
    next level. A key's index is the rank of its bit. What is left after the
    last level (practically nothing) is kept sorted.
    """

    def __init__(self, keys: np.ndarray, levels: int = 32, gamma: float = 2.0):
        self.bits, self.sizes, rest = [], [], keys
        for level in range(levels):
            if not len(rest):
                break
            size = max(64, int(len(rest) * gamma) + 63 & ~63)
            at = (_mixed(rest, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            self.sizes.append(size)
            rest = rest[~alone[at]]
        self.rest = np.sort(rest)
        counts = np.concatenate([np.zeros(1, np.int64)] + [np.bitwise_count(b).astype(np.int64) for b in self.bits])
        self.ranks = np.cumsum(counts)
        self.starts = np.cumsum([0] + [len(b) for b in self.bits])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Indexes; -1 or any index where a key was not built in."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, size) in enumerate(zip(self.bits, self.sizes, strict=True)):
            if not len(todo):
                return out
            at = _mixed(keys[todo], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            index = self.ranks[self.starts[level] + word] + np.bitwise_count(below)
            out[todo[there]] = index[there]
            todo = todo[~there]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            there = self.rest[at] == keys[todo]
            out[todo[there]] = self.ranks[-1] + at[there]
        return out


class Shard:
    """Arrays of one shard, in the order of its perfect hash."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray):
        # Keys that agree in the first hash (about never) stay out of the perfect hash, sorted aside.
        order = np.lexsort((h2, h1))
        h1, h2, count, last = h1[order], h2[order], count[order], last[order]
        twin = np.zeros(len(h1), bool)
        if len(h1) > 1:
            same = h1[1:] == h1[:-1]
            twin[1:] |= same
            twin[:-1] |= same
        self.twins = {(int(a), int(b)): int(c) for a, b, c in zip(h1[twin], h2[twin], last[twin], strict=True)}
        h1, h2, count, last = (x[~twin] for x in (h1, h2, count, last))
        self.hash = PerfectHash(h1)
        at = self.hash(h1)
        self.fingerprint, self.count, self.last = np.empty(len(h1), "<u8"), np.empty(len(h1), "u1"), np.empty(len(h1), "<i8")
        self.fingerprint[at], self.count[at], self.last[at] = h2, np.minimum(count, 255), last

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is indexed, and the document that keeps it."""
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        if len(self.last):
            at = self.hash(h1)
            found = (at >= 0) & (self.fingerprint[at] == h2)
            last = self.last[at]
        for k, doc in self.twins.items():
            hit = (h1 == k[0]) & (h2 == k[1])
            found, last = found | hit, np.where(hit, doc, last)
        return found, last


def _top_docs(h1, h2, doc, most):
    """The largest ``most`` distinct documents of each key, sorted by key."""
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[order], h2[order], doc[order]
    same_key = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    keep = np.ones(len(h1), bool)
    keep[:-1] = ~(same_key & (doc[1:] == doc[:-1]))
    h1, h2, doc = h1[keep], h2[keep], doc[keep]
    if len(h1) > most:
        late = np.ones(len(h1), bool)
        late[:-most] = (h1[:-most] != h1[most:]) | (h2[:-most] != h2[most:])
        h1, h2, doc = h1[late], h2[late], doc[late]
    return h1, h2, doc


def _batch_keys(batch, min_chars, keep_lines):
    """For each row with an id: distinct keys (hash pairs); lines too where asked for."""
    ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
    for doc, text in zip(ids, texts, strict=True):
        lines = (text or b"").split(b"\n")
        keys = [line_key(x, min_chars) for x in lines] if doc is not None else [None] * len(lines)
        yield doc, lines if keep_lines else None, keys


def _counting(min_chars: int, min_docs: int, shards: int):
    def run(batches):
        def flush(parts):
            h1, h2, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            n = np.bincount((h1 % np.uint64(shards)).astype(np.int64), minlength=0)
            h1, h2, doc = _top_docs(h1, h2, doc, min_docs)
            shard = (h1 % np.uint64(shards)).astype(np.int32)
            # The number of probes goes along once per shard and flush.
            probes = np.zeros(len(h1), np.int64)
            first = np.unique(shard, return_index=True)
            probes[first[1]] = n[first[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array(probes)],
                ["shard", "h1", "h2", "doc", "probes"],
            )

        release()
        parts, size = [], 0
        for batch in batches:
            keys, docs = [], []
            for doc, _, own in _batch_keys(batch, min_chars, False):
                own = {k for k in own if k is not None}
                keys += own
                docs += [doc] * len(own)
            if keys:
                parts.append((*_hashes(keys), np.array(docs, np.int64)))
                size += len(keys)
            if size >= _GATHER:
                yield from flush(parts)
                parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _building(min_docs: int):
    """Rows sorted by shard to one index row per shard."""

    def run(batches):
        def built(shard, parts):
            h1, h2, doc, probes = (np.concatenate(x) for x in zip(*parts, strict=True))
            h1, h2, doc = _top_docs(h1.view(np.uint64), h2.view(np.uint64), doc, min_docs)
            end = np.ones(len(h1), bool)
            end[:-1] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.flatnonzero(end)
            count = np.diff(np.concatenate([[-1], at]))
            most = count >= min_docs
            arrays = Shard(h1[at][most], h2[at][most], count[most], doc[at][most])
            blob = pickle.dumps(arrays, protocol=5) if most.any() else None
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([int(probes.sum())], pa.int64()), pa.array([int(most.sum())], pa.int64())],
                ["shard", "blob", "probes", "n_keys"],
            )

        now, parts = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cols = [batch.column(c).to_numpy() for c in ("h1", "h2", "doc", "probes")]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if now is not None and shard[a] != now:
                    yield built(now, parts)
                    parts = []
                now = int(shard[a])
                parts.append([c[a:b] for c in cols])
        if parts:
            yield built(now, parts)

    return run


def build_index(docs: DataFrame, id: str, text: str, min_chars: int, min_docs: int, shards: int) -> DataFrame:
    """One row per shard that has keys: shard, blob (a pickled ``Shard``), probes, n_keys."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_counting(min_chars, min_docs, shards), "shard int, h1 long, h2 long, doc long, probes long")
    return counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(_building(min_docs), "shard int, blob binary, probes long, n_keys long")


def _edit(texts, rows, dropped_of):
    """Kept texts and counts; ``dropped_of(rows)`` gives a mask over all keyed lines."""
    keyed = [(k, doc) for doc, _, keys in rows for k in keys if k is not None]
    gone = dropped_of(*_hashes([k for k, _ in keyed]), np.array([d for _, d in keyed], np.int64)) if keyed else np.zeros(0, bool)
    at, out, n_lines, n_gone = 0, [], [], []
    for text, (_, lines, keys) in zip(texts, rows, strict=True):
        n = sum(k is not None for k in keys)
        mask = gone[at : at + n]
        at += n
        n_lines.append(len(lines))
        n_gone.append(int(mask.sum()))
        if not mask.any():
            out.append(text)
            continue
        each = iter(mask)
        out.append(b"\n".join([x for x, k in zip(lines, keys, strict=True) if k is None or not next(each)]))
    return out, n_lines, n_gone


def _edited(batch, rows, dropped_of):
    """The batch with its text edited; ``n_lines`` is that of the first pass, ``n_dropped`` adds up."""
    out, n_lines, n_gone = _edit(batch.column("text").to_pylist(), rows, dropped_of)
    first = batch.column("n_lines").fill_null(0).to_numpy(zero_copy_only=False)
    made = {
        "text": pa.array(out, pa.binary()), "n_lines": pa.array(np.where(first > 0, first, np.array(n_lines, np.int64))),
        "n_dropped": pa.array(batch.column("n_dropped").to_numpy(zero_copy_only=False) + np.array(n_gone, np.int64)),
    }
    return pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in ("row", "id", "text", "n_lines", "n_dropped")], ["row", "id", "text", "n_lines", "n_dropped"])


def _probing(sent, shards: int, min_chars: int):
    """Probes a broadcast list of (shard, blob); lines of other shards stay."""

    def run(batches):
        index = {s: pickle.loads(blob) for s, blob in sent.value}

        def dropped(h1, h2, doc):
            gone, shard = np.zeros(len(h1), bool), (h1 % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a and (own := index.get(int(shard[order[a]]))) is not None:
                    at = order[a:b]
                    found, last = own.keeper(h1[at], h2[at])
                    gone[at] = found & (last != doc[at])
            return gone

        for batch in batches:
            for part in _bounded(batch):
                yield _edited(part, list(_batch_keys(part, min_chars, True)), dropped)

    return run


def _bounded(batch, rows: int = 512):
    """Slices, so that the objects of a batch of long texts don't pile up."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _sending(shards: int, min_chars: int):
    """Documents to distinct probes (shard, h1, h2, doc)."""

    def run(batches):
        for batch in batches:
            for part in _bounded(batch):
                keys, docs = [], []
                for doc, _, own in _batch_keys(part, min_chars, False):
                    own = {k for k in own if k is not None}
                    keys += own
                    docs += [doc] * len(own)
                if keys:
                    h1, h2 = _hashes(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((h1 % np.uint64(shards)).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(docs, pa.int64())],
                        ["shard", "h1", "h2", "doc"],
                    )

    return run


def _answering(batches):
    """Rows sorted by shard copy, its arrays first: emits the probes to drop."""
    own, now = None, None
    for batch in batches:
        shard, blobs = np.asarray(batch.column("place").to_numpy()), batch.column("blob")
        h1, h2, doc = (batch.column(c).fill_null(0).to_numpy() for c in ("h1", "h2", "doc"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if shard[a] != now:
                own, now = None, shard[a]
            if (blob := blobs[int(a)].as_py()) is not None:
                own, a = pickle.loads(blob), a + 1
            if own is not None and b > a:
                x, y, d = h1[a:b].view(np.uint64), h2[a:b].view(np.uint64), doc[a:b]
                found, last = own.keeper(x, y)
                gone = found & (last != d)
                yield pa.RecordBatch.from_arrays([pa.array(d[gone]), pa.array(x[gone].view(np.int64)), pa.array(y[gone].view(np.int64))], ["doc", "h1", "h2"])


def _dropping(min_chars: int):
    def run(batches):
        for batch in batches:
            for part in _bounded(batch):
                gone = set()
                for doc, own in zip(part.column("id").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    gone |= {(doc, x["h1"], x["h2"]) for x in own or ()}

                def dropped(h1, h2, doc, gone=gone):
                    return np.fromiter(((d, a, b) in gone for d, a, b in zip(doc.tolist(), h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), strict=True)), bool, len(doc))

                yield _edited(part, list(_batch_keys(part, min_chars, True)), dropped)

    return run


def _shards(docs: DataFrame) -> int:
    """As many as the input is large, by the estimate that Spark plans with."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(SHARDS, max(size // SHARD_BYTES, 2 * docs.sparkSession.sparkContext.defaultParallelism))


def _groups(index: DataFrame, broadcast_bytes: int) -> list[list[int]]:
    """Shards that have an index, in groups that fit (a larger shard is alone)."""
    out, total = [], 0
    for r in index.where("blob IS NOT NULL").select("shard", F.octet_length("blob").alias("n")).orderBy("shard").collect():  # SHARDS rows at most
        if not out or total + r.n > broadcast_bytes:
            out.append([])
            total = 0
        out[-1].append(r.shard)
        total += r.n
    return out


def _joined(rows: DataFrame, index: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """The documents edited by way of the shards: probes go there, the keys to drop come back."""
    total = index.agg(F.sum("probes")).first()[0]
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") * F.lit(shards) / F.lit(total))).cast("int")
    # One row per shard, of a few bytes: bounded by SHARDS.
    places = F.broadcast(index.where("blob IS NOT NULL").select("shard", copies.alias("copies")))
    place = lambda shard, copy: F.concat_ws("/", shard, copy)
    named = rows.where("id IS NOT NULL")
    probes = named.where("text IS NOT NULL").select("id", "text").mapInArrow(_sending(shards, min_chars), "shard int, h1 long, h2 long, doc long")
    probes = probes.join(places, "shard").select(
        place(F.col("shard"), F.pmod(F.xxhash64("doc", "h1"), F.col("copies"))).alias("place"), F.lit(None).cast("binary").alias("blob"), "h1", "h2", "doc",
    )
    null = F.lit(None).cast("long")
    arrays = index.where("blob IS NOT NULL").select(F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "shard", "blob")
    arrays = arrays.select(place(F.col("shard"), F.col("copy")).alias("place"), "blob", null.alias("h1"), null.alias("h2"), null.alias("doc"))
    gone = arrays.unionByName(probes).repartition("place").sortWithinPartitions("place", F.col("doc").asc_nulls_first())
    gone = gone.select(F.xxhash64("place").alias("place"), "blob", "h1", "h2", "doc")
    gone = gone.mapInArrow(_answering, "doc long, h1 long, h2 long").groupBy(F.col("doc").alias("gone_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    met = named.join(gone, F.col("id") == F.col("gone_id"), "left").drop("gone_id")
    # Rows without an id lose nothing: they don't meet in the join.
    return met.unionByName(rows.where("id IS NULL").withColumn("gone", F.lit(None).cast(met.schema["gone"].dataType))).mapInArrow(_dropping(min_chars), rows.schema)


def _edited_rows(docs: DataFrame, id: str, text: str, min_chars: int, min_docs: int, broadcast_bytes: int, passes: int) -> DataFrame:
    """row (all columns but the text), text, n_lines and n_dropped of each row."""
    spark, shards = docs.sparkSession, _shards(docs)
    index = stored(build_index(docs, id, text, min_chars, min_docs, shards), "line-index")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *others).alias("row"), F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"),
        F.lit(None).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
    )
    groups = _groups(index, broadcast_bytes)
    if len(groups) > passes:
        out = _joined(rows, index, shards, min_chars)
    else:
        for i, group in enumerate(groups or [[]]):
            rows = rows if i == 0 else stored(rows, "line-pass")
            blobs = index.where(F.col("shard").isin(group)).select("shard", "blob").collect() if group else []
            sent = spark.sparkContext.broadcast([(r.shard, bytes(r.blob)) for r in blobs])
            rows = rows.mapInArrow(_probing(sent, shards, min_chars), rows.schema)
        out = rows
    return out.withColumn("text", F.col("text").cast("string"))


def dedup_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES,
    passes: int = PASSES,
) -> DataFrame:
    """Drops lines whose key many documents hold, except in the largest id that holds it.

    Returns all columns of ``docs`` with the text edited, and a struct ``lines``
    of n_lines and n_dropped (a struct, so that columns of ``docs`` named like
    them don't clash; a column named ``lines`` is replaced).

    A null or empty text is one empty line and stays as it is. Rows with a null
    id neither count as documents nor lose lines. Rows that share an id are one
    document: a line in both counts once, and both keep or lose it. Ties cannot
    occur, as ids decide. Lines may be of any length; an empty table gives an
    empty one.
    """
    edited = _edited_rows(docs, id, text, min_chars, min_docs, broadcast_bytes, passes)
    return edited.select(*_own(docs, text, drop=("lines",)), F.struct("n_lines", "n_dropped").alias("lines"))


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``dedup_lines`` with the columns of ``docs`` alone, whatever their names."""
    settings = {"min_chars": MIN_CHARS, "min_docs": MIN_DOCS, "broadcast_bytes": BROADCAST_BYTES, "passes": PASSES} | options
    return _edited_rows(docs, id, text, **settings).select(*_own(docs, text))


def _own(docs: DataFrame, text: str, drop: tuple[str, ...] = ()):
    return [(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in drop]


#: DuckDB's form of ``op9``'s columns.
SQL = rf"""
WITH l AS (
  SELECT rid, doc_id, i, x AS line, regexp_replace(regexp_replace(x, '^[{SPACE_CLASS}]+', ''), '[{SPACE_CLASS}]+$', '') AS s
  FROM (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) a) b
), k AS (
  SELECT *, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), m AS (
  SELECT k.*, coalesce(c.last <> k.doc_id, false) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
