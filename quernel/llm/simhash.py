"""Near-duplicates by SimHash fingerprints and pivot distance tables.

1. Each text gets a 64-bit fingerprint of its word shingles.
2. Equal fingerprints become one row, so groups of exact copies cost one entry.
3. Two fingerprints at most ``max_bits`` apart agree in at least two of
   ``max_bits + 2`` blocks (pigeonhole). Every pair of blocks deals the distinct
   fingerprints into buckets; a link's two ends meet in at least one of them.
4. In a bucket each fingerprint has a table row of Hamming distances to many
   reference fingerprints. By the triangle inequality a pair whose rows differ
   by more than ``max_bits`` in any coordinate is no link; the first
   coordinate, sorted, gives the window, the largest difference decides, and
   the survivors are verified. Large buckets are searched breadth first over
   what is not yet reached, so a tight cluster of m fingerprints costs about m
   window scans and not m^2 pairs.
5. Tasks emit spanning forests, not pairs; components are then joined up.

No pair, link or component list reaches the driver.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import release, stored
from quernel.llm.components import components

SEED = 42
MAX_BITS = 4
#: Reference fingerprints, drawn from this seed.
PIVOTS = 32
PIVOT_SEED = 20240229
#: Buckets beyond this many members are searched breadth first.
_SMALL = 48
_FOREST = 1 << 18


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; the whole sequence is one where words are few."""
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    parts = map(joined.__getitem__, map(slice, starts, (ends[shingle - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles; 0 without words."""
    words = (text or b"").lower().split()
    return majority(shingle_hashes(words, shingle)) if words else 0


def _fingerprints(shingle: int):
    def run(batches):
        release()
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) per row; fp as a signed long."""
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(_fingerprints(shingle), "id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, n, np.uint64)


def _table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Distances to the references; one row per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def rows(self):
        wrapped = lambda x: [v - (1 << 64) if v >> 63 > 0 else v for v in x]
        a, b = (np.array(wrapped(x), np.int64) for x in (zip(*self.edges, strict=True) if self.edges else ([], [])))
        self.up, self.edges = {}, []
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def link_small(fps: np.ndarray, group: np.ndarray, refs: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """Links within many small groups at once; rows sorted by group."""
    table = _table(fps, refs)
    n, k = len(fps), 1
    at = np.flatnonzero(group[:-1] == group[1:]) if n > 1 else np.zeros(0, np.int64)
    while len(at):
        a, b = at, at + k
        for p in range(table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, p] - table[b, p]) <= max_bits
            a, b = a[near], b[near]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        for x, y in zip(fps[a[close]].tolist(), fps[b[close]].tolist(), strict=True):
            forest.link(x, y)
        k += 1
        at = at[at + k < n]
        at = at[group[at] == group[at + k]]


def link_large(fps: np.ndarray, refs: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """Breadth-first search over what is not yet reached, in windows of the first coordinate."""
    table = _table(fps, refs)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first, open_ = table[:, 0].astype(np.int64), np.ones(len(fps), bool)
    lo, hi = np.searchsorted(first, first - max_bits), np.searchsorted(first, first + max_bits, "right")
    for start in range(len(fps)):
        if not open_[start]:
            continue
        open_[start], queue = False, [start]
        while queue:
            i = queue.pop()
            at = lo[i] + np.flatnonzero(open_[lo[i] : hi[i]])
            if len(at):
                at = at[np.abs(table[at] - table[i]).max(1) <= max_bits]
                at = at[np.bitwise_count(fps[at] ^ fps[i]) <= max_bits]
                open_[at] = False
                queue += at.tolist()
                for j in at.tolist():
                    forest.link(int(fps[i]), int(fps[j]))


def _linking(max_bits: int, n_pivots: int):
    """Rows sorted by (c, key) to forest edges of their buckets."""

    def run(batches):
        refs, forest = pivots(n_pivots), _Forest()

        def search(fps, c, key):
            if len(fps) < 2:
                return
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (key[1:] != key[:-1])])
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            of = sizes[group]
            small = (of > 1) & (of <= _SMALL)
            if small.any():
                link_small(fps[small], group[small], refs, max_bits, forest)
            for g in np.flatnonzero(sizes > _SMALL):
                link_large(fps[slice(*np.searchsorted(group, [g, g + 1]))], refs, max_bits, forest)

        parts: list = []
        whole = lambda: [np.concatenate(x) for x in zip(*parts, strict=True)]
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(x).to_numpy() for x in ("fp", "c", "key")]
            _, c, key = now
            if parts and (parts[-1][1][-1], parts[-1][2][-1]) != (c[0], key[0]):
                fps, *of = whole()
                search(fps.view(np.uint64), *of)
                parts = []
            new = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1]))
            if len(new):  # the last bucket may go on in the next batch
                cut = int(new[-1]) + 1
                parts.append([x[:cut] for x in now])
                fps, *of = whole()
                search(fps.view(np.uint64), *of)
                parts, now = [], [x[cut:] for x in now]
            parts.append(now)
            if len(forest.edges) >= _FOREST:
                yield forest.rows()
        if parts:
            fps, *of = whole()
            search(fps.view(np.uint64), *of)
        yield forest.rows()

    return run


def block_masks(max_bits: int) -> list[int]:
    """A mask for each pair of ``max_bits + 2`` blocks of the 64 bits."""
    n = max_bits + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [a | b for a, b in combinations(blocks, 2)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at most ``max_bits`` apart.

    ``fps`` holds distinct fingerprints ``fp``.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(max_bits)]
    dealt = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("c", "key"))
    return dealt.repartition("c", "key").sortWithinPartitions("c", "key").mapInArrow(_linking(max_bits, n_pivots), "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long), component_id.

    component_id is the smallest id reachable over links of at most
    ``max_bits``. A text of fewer words than ``shingle`` is one shingle; a null
    text, or one without words, has fingerprint zero and links like any other.
    A null id is never a component_id; where a component has only null ids it is
    null. Repeated rows each get their row. Lengths are unlimited, further
    columns are ignored, an empty table gives an empty one.
    """
    own = stored(fingerprints(docs, id, text, shingle), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits, n_pivots))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only linked fingerprints have another's root.
    linked = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return own.join(linked, own.fp == linked.of).select("id", "fp", "component_id")
