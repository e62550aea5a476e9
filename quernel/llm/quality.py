"""Quality rules: a threshold table compiled into one projection.

Every measure and every rule is a built-in expression over the row's own text,
so the operator is one narrow stage: no shuffle, no user function, no state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import SPACE_CHARS, SPACE_CLASS, let, words_of

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Words in a window whose second occurrence makes it repeated.
WINDOW = 8
#: Function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "was", "on", "as", "are", "with", "be", "at", "this", "by", "from", "a", "an", "or", "not", "have",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "auf", "für", "ein", "eine", "mit", "im", "dem", "nicht", "als", "auch",
    "le", "la", "les", "de", "des", "et", "est", "un", "une", "pour", "dans", "que", "qui", "sur", "pas", "du", "au", "aux", "ne", "ce",
    "el", "los", "las", "y", "es", "en", "por", "con", "una", "para", "del", "se", "no", "lo", "su",
)
#: Stripped from both ends of a word before it is looked up among the stop words.
EDGE_MARKS = ".,;:!?\"'()[]"


@dataclass(frozen=True)
class Rule:
    """Fails a document whose ``parts * measure`` leaves ``[low * per, high * per]``.

    All in whole numbers, so that every engine decides alike. A ``low`` or
    ``high`` of None is open.
    """

    name: str
    measure: str
    per: str
    parts: int = 100
    low: int | None = None
    high: int | None = None

    def failed(self) -> Column:
        value, per = F.lit(self.parts) * F.col(self.measure), F.col(self.per)
        tests = [value < F.lit(self.low) * per] if self.low is not None else []
        tests += [value > F.lit(self.high) * per] if self.high is not None else []
        return reduce(Column.__or__, tests)

    def sql(self) -> str:
        tests = [f"{self.parts} * {self.measure} < {self.low} * {self.per}"] if self.low is not None else []
        tests += [f"{self.parts} * {self.measure} > {self.high} * {self.per}"] if self.high is not None else []
        return f"({' OR '.join(tests)})"


#: The production thresholds, in hundredths.
RULES = (
    Rule("length", "n_words", "one", parts=1, low=20),
    Rule("repeats", "n_repeat_words", "n_words", high=30),
    Rule("word_length", "word_chars", "n_words", parts=1, low=2, high=20),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
    Rule("dup_lines", "n_dup_lines", "n_text_lines", high=50),
)
#: The first two are the base rules.
BASE_RULES = RULES[:2]


def _without(text: Column, chars: str) -> Column:
    """``text`` without ``chars``, one byte search per character."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a ``window``-word window that occurs twice or more.

    Windows are compared by a 64-bit hash of their words. Texts without a
    repeated window stop at a hash-set count; the others sort (hash, position)
    pairs and add up the covered positions: n log n, whatever the length.
    """

    def covered(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(pairs, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda e, i: _same(s, i - 1, e) | _same(s, i + 1, e)), lambda e: e["p"])), spread))

    def _same(pairs: Column, at: Column, e: Column) -> Column:
        return F.coalesce(F.get(pairs, at)["h"] == e["h"], F.lit(False))

    def spread(d: Column) -> Column:
        steps = F.transform(d, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(d, j + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys))

    keys = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(let(keys(w), counted)))


def measures(text: Column) -> dict[str, Column]:
    """The measures that rules can name."""
    full = F.coalesce(text, F.lit(""))
    spaced = _without(full, SPACE_CHARS)
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))

    def of_words(w: Column) -> Column:
        stops = F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(EDGE_MARKS))).isin(*STOP_WORDS)))
        return F.struct(F.size(w).cast("long").alias("n"), stops.cast("long").alias("stops"), repeated_words(w).alias("repeats"))

    return {
        "_w": let(words_of(text), of_words),
        "word_chars": F.length(spaced).cast("long"),
        "n_symbols": (F.length(full) - F.length(_without(full, SYMBOLS))).cast("long"),
        "_l": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
    }


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdict for every row: one row out per row in.

    Columns: ``keep``, the measures, ``base_failed``, ``failed_rules`` (names,
    in table order) and ``kept``. A null text counts as empty: all measures
    zero, ``base_failed`` true. Null ids stay null, repeated rows each get
    their row, an empty table gives an empty one, and further columns are
    ignored whatever their names.
    """
    m = measures(F.col(text))
    inner = docs.select(*(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)), *(e.alias(n) for n, e in m.items()))
    flat = inner.select(
        *(F.col(f"k_{i}") for i in range(len(keep))),
        F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"),
        F.col("_w.repeats").alias("n_repeat_words"), F.col("_w.stops").alias("n_stop_words"), F.col("_l.n").alias("n_text_lines"), F.lit(1).cast("long").alias("one"),
    )
    base = reduce(Column.__or__, [r.failed() for r in BASE_RULES])
    failed = F.array_compact(F.array(*(F.when(r.failed(), F.lit(r.name)) for r in rules)))
    return flat.select(
        *(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~reduce(Column.__or__, [r.failed() for r in rules])).alias("kept"), "n_stop_words", "n_text_lines", failed.alias("failed_rules"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    row = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return score_quality(row, rules, "text", keep=("row",)).where("kept").select("row.*")


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: DuckDB's form of ``op10``'s columns.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^{SPACE_CLASS}]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE_CLASS}]')) AS ls FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}) z
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) z WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM dup) z GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains([{_sql_list(STOP_WORDS)}], lower(trim(x, {_sql_list([EDGE_MARKS])})))))::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_text_lines, 1 AS one
  FROM w LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {" OR ".join(r.sql() for r in BASE_RULES)} AS base_failed,
       NOT ({" OR ".join(r.sql() for r in RULES)}) AS kept, n_stop_words, n_text_lines,
       list_filter([{", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS failed_rules
FROM m
"""
