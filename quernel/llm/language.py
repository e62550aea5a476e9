"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` is counted, with all
256 symbols and every context seen. A symbol's probability in a context is its
count over the context's total plus its number of distinct symbols; the rest is
the escape, which the next shorter context shares out among the symbols not
seen here (exclusion), down to a uniform distribution. So the code length of an
unseen symbol is an escape length that depends on the context alone, plus the
length one order below, and a tree is laid out as sorted arrays for each order:
grams seen with their code lengths, and contexts seen with their escapes.
Statistics are frozen after training. A text's score is the exact sum over all
its bytes.

Training takes a hashed sample of labelled rows (``sample`` documents a
language, on average); a tree is built where its language's counts meet, and
only finished trees come to the driver. Scoring covers all rows and whole
texts. While all trees together fit ``broadcast_bytes`` (measured) one narrow
stage scores them; beyond that the languages are dealt to shards that do, and
the texts pass by one shard after the other.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import stored

#: Labelled documents that a language is learned from, on average.
SAMPLE = 600
#: Bytes of the longest context, 7 at most.
ORDER = 4
#: Most bytes of trees that are broadcast together.
BROADCAST_BYTES = 128 << 20
#: Bytes scored at once.
_BLOCK = 1 << 18
#: Languages whose trees are looked up together.
_TOGETHER = 8
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Stands before a text, once for each byte of the longest context.
_START = b"\n"
UNKNOWN = "und"


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Codes of all runs of ``order`` + 1 bytes."""
    n, out = len(data) - order, np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(order + 1):
        out = out << np.uint64(8) | data[k : k + n].astype(np.uint64)
    return out


def _counted(order: int):
    def run(batches):
        held: dict[str, list] = {}

        def flush(lang):
            codes, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(np.frombuffer(_START * order + text, np.uint8), order))
                if sum(map(len, held[lang])) > 1 << 22:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    return run


def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``of`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return at, keys[at] == of


class Tree:
    """One language: for each order, sorted grams with bits and sorted contexts with the bits of their escapes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, order: int = ORDER):
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        eight = np.uint64(8)
        for k in range(order + 1):
            seen, back = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(back, n, len(seen))
            contexts, of = np.unique(seen >> eight, return_inverse=True)
            total, distinct = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
            if k:  # a gram seen here is seen one order below
                lower = self.bits[-1][np.searchsorted(self.grams[-1], seen & np.uint64((1 << 8 * k) - 1))]
            else:
                lower = np.full(len(seen), 8.0)
            free = np.maximum(1 - np.bincount(of, np.exp2(-lower), len(contexts)), 1e-12)
            full = distinct == 256  # no escape
            self.grams.append(seen)
            self.bits.append(-np.log2(count / (total + np.where(full, 0, distinct))[of]))
            self.contexts.append(contexts)
            self.escapes.append(np.where(full, 0, np.log2((total + distinct) / distinct) + np.log2(free)))


class Forest:
    """Trees of a few languages side by side."""

    def __init__(self, trees: list[Tree]):
        self.order = len(trees[0].grams) - 1
        self.n, self.levels = len(trees), []
        for k in range(self.order + 1):
            made = []
            for keys, values, unseen in (([t.grams[k] for t in trees], [t.bits[k] for t in trees], np.nan), ([t.contexts[k] for t in trees], [t.escapes[k] for t in trees], 0)):
                every = np.unique(np.concatenate(keys))
                table = np.full((len(every), len(trees)), unseen, np.float64)
                for i, (key, value) in enumerate(zip(keys, values, strict=True)):
                    table[np.searchsorted(every, key), i] = value
                made += [every, table]
            self.levels.append(made)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last symbol after its others, a column per language."""
        out, open_ = np.zeros((len(codes), self.n)), np.ones((len(codes), self.n), bool)
        for k in range(self.order, -1, -1):
            every, bits, contexts, escapes = self.levels[k]
            code = codes & np.uint64((1 << 8 * (k + 1)) - 1)
            at, there = _find(every, code)
            seen = there[:, None] & open_ & ~np.isnan(bits[at])
            out[seen] += bits[at][seen]
            open_ &= ~seen
            at, there = _find(contexts, code >> np.uint64(8))
            out += np.where(there[:, None] & open_, escapes[at], 0)
        return out + 8 * open_


class Model:
    """Code lengths in bits."""

    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs = langs
        self.order = len(trees[0].grams) - 1
        self.forests = [Forest(trees[a : a + _TOGETHER]) for a in range(0, len(trees), _TOGETHER)]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        parts, owner, size, start = [], [], 0, _START * self.order

        def score():
            # What would be scored across two parts falls out, as a part starts with context only.
            ends = np.cumsum([len(p) for p in parts])
            codes = grams(np.frombuffer(b"".join(parts), np.uint8), self.order)
            distinct, at = np.unique(codes, return_inverse=True)
            for f, forest in enumerate(self.forests):
                bits = forest.bits(distinct)
                for i, end, p in zip(owner, ends.tolist(), parts, strict=True):
                    if len(p) > self.order:
                        out[i, f * _TOGETHER : f * _TOGETHER + forest.n] += bits[at[end - len(p) : end - self.order]].sum(0)

        for i, text in enumerate(texts):
            for at in range(0, len(text), _BLOCK):
                parts.append((start + text[:_BLOCK]) if at == 0 else text[at - self.order : at + _BLOCK])
                owner.append(i)
                size += len(parts[-1])
                if size >= _BLOCK:
                    score()
                    parts, owner, size = [], [], 0
        if parts:
            score()
        return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def held_out(id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _built(order: int):
    def run(key, table):
        codes, n = (table.column(c).to_numpy() for c in ("code", "n"))
        tree = Tree(codes.view(np.uint64), n.astype(np.float64), order)
        size = sum(x.nbytes for level in (tree.grams, tree.bits, tree.contexts, tree.escapes) for x in level)
        return pa.table({"lang": pa.array([key[0].as_py()]), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary()), "size": pa.array([size], pa.int64())})

    return run


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """(lang, tree, size) for each language of the labelled rows with an id that are not held out; a written table.

    The sample is ``sample`` documents a language on average; nothing of their
    texts is left out of the statistics.
    """
    if not 1 <= order <= 7:
        raise ValueError("the order lies between 1 and 7")
    rows = docs.where(F.col(id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id)))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("l")).count().collect()}  # a row per language
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), F.col(id).cast("long")), F.lit(1 << 30)) < share * float(1 << 30))
    drawn = drawn.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    counts = drawn.mapInArrow(_counted(order), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return stored(counts.groupBy("lang").applyInArrow(_built(order), "lang string, tree binary, size long"), "language-trees")


def load(trees: DataFrame, langs: list[str]) -> Model | None:
    """The model of some languages, in order of their names; None for none. For trees whose size is checked."""
    rows = sorted(trees.where(F.col("lang").isin(langs)).select("lang", "tree").collect()) if langs else []
    return Model([r.lang for r in rows], [pickle.loads(r.tree) for r in rows]) if rows else None


def shards(trees: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> list[list[str]]:
    """Languages in order, cut so that each part's trees fit ``broadcast_bytes`` (a larger one is alone)."""
    out, size = [], 0
    for r in trees.select("lang", "size").orderBy("lang").collect():  # a row per language
        if not out or size + r["size"] > broadcast_bytes:
            out.append([])
            size = 0
        out[-1].append(r.lang)
        size += r["size"]
    return out


def predict(langs: list[str], bits: list[list[float]]) -> tuple[list[str], list[float]]:
    """Best language and its share of the total likelihood, for each text's code lengths; ``und`` for none."""
    names, scores = [UNKNOWN] * len(bits), [0.0] * len(bits)
    at = [i for i, b in enumerate(bits) if b]
    if at:
        table = np.array([bits[i] for i in at])
        best = table.argmin(1)
        share = 1 / np.exp2(np.maximum(-1000, table.min(1, keepdims=True) - table)).sum(1)
        for i, b, s in zip(at, best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = langs[b], s
    return names, scores


def _scoring(sent, langs: list[str] | None):
    """Appends the code lengths of a shard's languages to ``bits`` (empty for a text without a letter).

    With ``langs``, the languages of all shards, this is the last one: the
    prediction comes out and the texts stay behind.
    """

    def run(batches):
        model = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts, bits = part.column("text").to_pylist(), part.column("bits").to_pylist()
                at = [i for i, t in enumerate(texts) if t and has_letter(t)] if model is not None else []
                for i, row in zip(at, model.bits([texts[i] for i in at]).tolist() if at else (), strict=True):
                    bits[i] = bits[i] + row
                if langs is None:
                    out = pa.array(bits, pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([out if n == "bits" else part.column(n) for n in part.schema.names], part.schema.names)
                else:
                    names, scores = predict(langs, bits)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                        ["id", "held_out", "lang_pred", "score"],
                    )

    return run


def identify(docs: DataFrame, trees: DataFrame, id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row: id, held_out, lang_pred, score. ``trees`` are those of ``learn``.

    ``und`` with score zero where the text is null or has no letter, or nothing
    was learned. Equal code lengths go to the language first in order. Ids may
    be null or repeat, texts of any length are scored whole in blocks of 256 KB,
    further columns are ignored, an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), held_out(F.col(id)).alias("held_out"), F.col(text).cast("binary").alias("text"), F.array().cast("array<double>").alias("bits"))
    kind, parts = rows.schema["id"].dataType.simpleString(), shards(trees, broadcast_bytes)
    every = [x for part in parts for x in part]
    send = lambda langs: spark.sparkContext.broadcast(load(trees, langs))  # noqa: E731 (its size is checked above)
    for langs in parts[:-1]:  # one shard's trees in a worker at a time
        rows = stored(rows.mapInArrow(_scoring(send(langs), None), rows.schema), "language-bits")
    out = rows.mapInArrow(_scoring(send(parts[-1] if parts else []), every), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id)
