"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed by token count to tiers of context sizes (2048, 1024, 512,
256). Windows of the longest size are cut from long documents first; each tier
then packs its own documents, long tiers first, and fills the gaps of its
windows from the shorter tiers: with whole documents while one fits, in the end
with a cut one. Windows are therefore full. What a task has left at its end is
cut into windows of falling powers of two, so nothing is padded at all.

Sequences of equal length are dealt into step groups of equal token totals. A
task fills groups of its own; the sequences that its last, open groups hold
(less than a group for each length) are dealt anew over all tasks, by numbers
counted in a table with a row for each task and length. So at most one group of
each length falls short.

A task works on its own input split in bounded rounds: memory for one round of
documents, and no shuffle but that of the pieces in open groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import short_batches, stored, trim
from quernel.llm.tokens import CACHE, encoder, vocabulary

MODEL = "byte_bpe_50k.json"
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens of a step group.
STEP_TOKENS = 64 * 2048
#: Tokens that a round gathers before it packs.
ROUND = 1 << 21
#: Bytes of texts that are encoded in one go, but for one text at least.
_BYTES = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
_MADE = SCHEMA + ", nth long"


class Packer:
    """Packs pieces (doc, ids, start, length) and gives rows of ``SCHEMA``."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, part: int = 0, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
            raise ValueError("tiers are falling powers of two")
        self.tiers, self.step_tokens, self.base = tiers, step_tokens, part << 40
        self.pools: dict[int, list] = {t: [] for t in tiers}
        self.made: dict[int, int] = {}
        #: Rows of the sequences in the open step group of each length, and their places in it.
        self.open: dict[int, tuple[list, list]] = {}
        #: Finished rows without the last two columns, and these.
        self.n, self.rows, self.steps, self.places = 0, [], [], []

    def route(self, doc, ids: np.ndarray, start: int, length: int) -> None:
        """Whole windows of the longest tier leave at once; the rest goes to the tier that holds it."""
        longest = self.tiers[0]
        while length >= longest:
            self._emit(longest, [(doc, ids, start, longest)])
            start, length = start + longest, length - longest
        if length:
            self.pools[next(t for t in reversed(self.tiers) if t >= length)].append((doc, ids, start, length))

    def _emit(self, size: int, pieces: list) -> None:
        nth, each = self.made.get(size, 0), max(1, self.step_tokens // size)
        self.made[size] = nth + 1
        held, places = self.open.setdefault(size, ([], []))
        offset, sequence = 0, self.base + self.n
        for doc, ids, start, length in pieces:
            held.append((doc, start, length, zlib.crc32(ids[start : start + length].data), len(ids), sequence, offset, size))
            offset += length
        places += [nth % each] * len(pieces)
        self.n += 1
        if (nth + 1) % each == 0:
            self._finish(held, [self.base + (nth // each << 12) + size.bit_length()] * len(held), [None] * len(held))
            del self.open[size]

    def _finish(self, rows: list, steps: list, places: list) -> None:
        self.rows += rows
        self.steps += steps
        self.places += places

    def _next(self, gap: int):
        """A pool to fill ``gap`` from: the longest tier that surely fits, else the shortest with any."""
        fits = next((t for t in self.tiers if t <= gap and self.pools[t]), None)
        return fits or next((t for t in reversed(self.tiers) if self.pools[t]), None)

    def pack(self, last: bool = False) -> None:
        for tier in self.tiers:
            pool = self.pools[tier]
            while pool:
                window = [pool.pop()]
                gap = tier - window[0][3]
                while gap and (source := self._next(gap)):
                    doc, ids, start, length = self.pools[source].pop()
                    take = min(gap, length)
                    window.append((doc, ids, start, take))
                    gap -= take
                    if length > take:
                        self.route(doc, ids, start + take, length - take)
                if not gap:
                    self._emit(tier, window)
                    continue
                # All pools are empty: what is left waits for more, or ends in falling powers of two.
                if not last:
                    for piece in window:
                        self.route(*piece)
                    return
                self._tail(window)

    def _tail(self, pieces: list) -> None:
        total = sum(p[3] for p in pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            window, gap = [], size
            while gap:
                doc, ids, start, length = pieces.pop(0)
                take = min(gap, length)
                window.append((doc, ids, start, take))
                gap -= take
                if length > take:
                    pieces.insert(0, (doc, ids, start + take, length - take))
            self._emit(size, window)
            total -= size

    def close(self) -> None:
        """Rows of open step groups get their place among the open ones (``nth``) instead of a group."""
        for held, places in self.open.values():
            self._finish(held, [None] * len(held), places)
        self.open = {}

    def taken(self):
        """The rows so far, as one batch."""
        cols = [*(zip(*self.rows, strict=True) if self.rows else [[]] * 8), self.steps, self.places]
        self.rows, self.steps, self.places = [], [], []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in _MADE.split(", ")])


def _parts(batch: pa.RecordBatch):
    """The batch in slices of about ``_BYTES`` of text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // _BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _packing(path_of, model: str, tiers: tuple[int, ...], step_tokens: int, cache: int):
    def run(batches):
        enc = encoder(path_of(model))
        packer, held = Packer(tiers, TaskContext.get().partitionId(), step_tokens), 0
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for part in _parts(batch):
                for doc, ids in zip(part.column("id").to_pylist(), enc.token_ids(part.column("text"), cache), strict=True):
                    ids = np.concatenate([ids, end])
                    packer.route(doc, ids, 0, len(ids))
                    held += len(ids)
                if held >= ROUND:
                    packer.pack()
                    yield packer.taken()
                    held = 0
                    trim()
        packer.pack(last=True)
        packer.close()
        if packer.rows:
            yield packer.taken()

    return run


def _regrouped(open_: DataFrame, step_tokens: int) -> DataFrame:
    """Pieces of open step groups, dealt to groups over all tasks."""
    part = F.shiftright("sequence_id", 40)
    counts = open_.groupBy(part.alias("c_part"), F.col("tier").alias("c_tier")).agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("c_tier").orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("c_part", "c_tier", F.coalesce(before, F.lit(0)).alias("first"))
    dealt = open_.join(starts, (part == F.col("c_part")) & (F.col("tier") == F.col("c_tier")))
    each = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    group = F.lit(1 << 62) + F.shiftleft(F.floor((F.col("first") + F.col("nth")) / each).cast("long"), 12) + F.length(F.bin("tier"))
    return dealt.withColumn("step_group", group).select(*(x.split()[0] for x in SCHEMA.split(", ")))


def pack_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
    path_of=vocabulary, cache: int = CACHE,
) -> DataFrame:
    """One row per piece, columns as in ``SCHEMA``.

    A document's ids are its text's, then ``END_ID``; each id of each row lies
    in exactly one piece. A null or empty text is the end id alone. ``tier`` is
    the sequence's length, and step groups hold sequences of one length. Null
    ids stay null, repeated rows are packed each for themselves, texts may be
    of any length, further columns are ignored, an empty table gives an empty
    one. A worker remembers the ids of ``cache`` pieces of words at most,
    which takes memory and saves time.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    with short_batches(docs.sparkSession):
        made = stored(rows.mapInArrow(_packing(path_of, model, tiers, step_tokens, cache), _MADE), "pieces")
    return made.where("nth IS NULL").drop("nth").unionByName(_regrouped(made.where("nth IS NOT NULL"), step_tokens))
