"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths (in tokens) of the corpus' most
frequent pre-token units, of bounded size; tier two a cache in each worker for
the rest, filled by the tokenizer. No pre-token is ever shuffled.

The table is found over all documents: each task keeps a bounded summary of its
words' counts (lossy: rare ones are forgotten when it is full), and summaries
are merged in a tree of bounded fan-in. Which units are in the table decides
speed only, never a count.
"""

from __future__ import annotations

import pickle
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import stored
from quernel.llm.tokens import LONGEST, encoder, vocabulary

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of the broadcast table: at most so many units of at most LONGEST characters, about 5 MB.
TABLE = 1 << 15
#: Entries of a task's summary; twice as many are held at most between trims of the counter below.
SUMMARY = 1 << 13
_HELD = 1 << 18
FAN_IN = 32
_ROWS = 256


def _summaries(batches):
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            # Nearly all units are a space and a word; cutting words is far cheaper than cutting units.
            counts.update(text.split())
            if len(counts) > _HELD:
                counts = Counter(dict(counts.most_common(_HELD // 4)))
    if counts:
        yield _summary(counts, SUMMARY)


def _summary(counts: Counter, most: int):
    # Ties are cut by the unit itself, so that reruns agree.
    top = sorted(((-n, u) for u, n in counts.items() if len(u) <= LONGEST and n > 1))[:most]
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps({u: -n for n, u in top})], pa.binary())], ["summary"])


def _merged(batches):
    counts: Counter = Counter()
    for batch in batches:
        for x in batch.column("summary").to_pylist():
            counts.update(pickle.loads(x))
    if counts:
        yield _summary(counts, TABLE)


def frequent_units(docs: DataFrame, text: str = "text") -> list[str]:
    """The corpus' frequent units (a space and a frequent word), most frequent first, at most TABLE of them."""
    texts = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")
    rows = stored(texts.mapInArrow(_summaries, "summary binary"), "summaries")
    n = rows.count()
    while n > 1:
        n = -(-n // FAN_IN)
        rows = stored(rows.repartition(n).mapInArrow(_merged, "summary binary"), "summaries")
    top = rows.collect()  # one row of bounded size
    return [f" {word}" for word in pickle.loads(top[0].summary)] if top else []


def _counting(path_of, model: str, sent):
    def run(batches):
        enc, frequent = encoder(path_of(model)), sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                counts = enc.token_counts([t or "" for t in part.column("text").to_pylist()], frequent)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL, limit: int = LIMIT, path_of=vocabulary) -> DataFrame:
    """One row per row: id, n_bytes (UTF-8), n_tokens, over_limit.

    ``path_of(model)`` gives the file's place on the worker. Without begin, end
    or added special tokens; strings of special tokens inside a text are
    handled as the library does by default. A null or empty text has no bytes
    and no tokens. Null ids stay, repeated rows each get their row, further
    columns are ignored, an empty table gives an empty one.
    """
    enc = encoder(path_of(model))
    units = frequent_units(docs, text) if enc.by_unit else []
    # A unit that holds an added token's string never comes up: such texts are encoded whole.
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(units, map(len, enc.encode(units)), strict=True)) if units else {})
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(_counting(path_of, model, sent), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
