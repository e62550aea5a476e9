"""Secret scan with corpus-wide ownership frequency, in built-in functions only.

One pass over the texts finds the spans of three fixed kinds and, beside them,
credential-like tokens. The hashes of all found values are then counted by
distinct documents and owners (sources). A value that several owners hold is a
copied example; one that a single owner holds looks live, in however many of
its documents: copies within an owner say nothing (``max_docs`` may bound them).
Live tokens are reported as spans of the kind ``owned``; base spans always
stay, and ``n_live`` and ``n_shared`` tell the two classes apart.

Only spans and hashes leave the scan: no text is shuffled and no value stored.
A value in a third of all documents is combined before the shuffles that count
it, and the join back is left to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import let, stored


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


#: Names before an assigned secret (fixed values); a trailing ? makes the last character optional.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(_any_case(x) for x in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN_CLASS = "[A-Za-z0-9+/_.=-]"
TOKEN = TOKEN_CLASS + "{20,}"
MIN_ASSIGNED = 6
#: Kinds in their order where spans start together.
KINDS = ("assign", "access", "hex", "owned")
#: Owners of a live value.
MAX_OWNERS = 1
_BLOCK = 256


def _starts(gaps: Column, lengths: Column) -> Column:
    """Start of each match from the lengths of gaps and matches, in blocks: sums of few are appended to at a time."""
    long = lambda x: F.lit(x).cast("long")
    none = F.array().cast("array<long>")
    pairs = F.arrays_zip(gaps.alias("g"), lengths.alias("m"))

    def of_block(block: Column) -> Column:
        start = F.struct(long(0).alias("pos"), none.alias("at"))
        return F.aggregate(block, start, lambda a, x: F.struct((a["pos"] + x["g"] + x["m"]).alias("pos"), F.concat(a["at"], F.array(a["pos"] + x["g"])).alias("at")))

    def of_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / _BLOCK).cast("int") - 1), lambda b: of_block(F.slice(p, b * _BLOCK + 1, _BLOCK)))
        start = F.struct(long(0).alias("pos"), F.array().cast("array<array<long>>").alias("at"))
        moved = lambda a, x: F.struct((a["pos"] + x["pos"]).alias("pos"), F.concat(a["at"], F.array(F.transform(x["at"], lambda s: s + a["pos"]))).alias("at"))
        return F.flatten(F.aggregate(blocks, start, moved)["at"])

    return let(pairs, of_blocks)


def matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches: kind, start, end (code points), value."""
    length = lambda x: F.length(x).cast("long")
    span = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"

    def found(full: Column) -> Column:
        starts = _starts(F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(full)), length), F.transform(full, length))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else full
        zipped = F.arrays_zip(starts.alias("s"), full.alias("f"), values.alias("v"))
        return F.transform(
            zipped, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["f"])).alias("end"), x["v"].alias("value")),
        ).cast(span)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda full: F.when(F.size(full) == 0, F.array().cast(span)).otherwise(found(full)))


def _spans_of(text: Column) -> Column:
    """Base spans and, apart, credential-like tokens outside them, of a non-null text."""
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= MIN_ASSIGNED)
    base = F.concat(assign, matches(text, ACCESS, 1), matches(text, f"(?<![0-9a-f]){HEX}", 2))
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    tokens = F.filter(matches(text, f"(?<!{TOKEN_CLASS}){TOKEN}", 3), mixed)
    apart = lambda b: F.filter(tokens, lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return let(base, lambda b: F.struct(b.alias("base"), apart(b).alias("tokens")))


def _hidden(spans: Column) -> Column:
    """Values become hashes."""
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))


def scan(docs: DataFrame, id: str, text: str, owner: str) -> DataFrame:
    """One row per document: row number, id, owner, and its spans with hashed values. One narrow stage."""
    rows = docs.select(F.col(id).alias("id"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.select("id", "owner", let(F.col("text"), _spans_of).alias("f"))
    return found.select(F.monotonically_increasing_id().alias("rid"), "id", "owner", _hidden(F.col("f.base")).alias("base"), _hidden(F.col("f.tokens")).alias("tokens"))


def ownership(hits: DataFrame) -> DataFrame:
    """(hash, owner, id) to hash, n_owners, n_docs, both distinct. A null owner is one owner, a null id one document of its owner."""
    by_doc = hits.groupBy("hash", "owner", "id").agg(F.lit(1).alias("one"))
    by_owner = by_doc.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_docs"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", max_owners: int = MAX_OWNERS, max_docs: int | None = None) -> DataFrame:
    """One row per row: id, n_assign, n_access, n_hex, base_spans, spans, n_live, n_shared.

    Span lists read ``kind:start:end``, comma-joined by start, then kind, in
    code points with exclusive ends; ``spans`` holds the base spans and the
    owned tokens. ``n_live`` and ``n_shared`` split all reported base spans by
    whether their value looks live. A null text is empty, texts are searched
    whole; the tokens of one text are compared with its base spans, so time
    grows with the product of the two in a text that is full of both. Repeated
    rows each get their row and count as one document where their ids agree.
    Further columns are ignored, an empty table gives an empty one.
    """
    found = stored(scan(docs, id, text, owner), "secret-spans")
    some = found.where((F.size("base") > 0) | (F.size("tokens") > 0))
    hits = some.select("rid", "id", "owner", F.explode(F.concat("base", "tokens")).alias("x")).select("rid", "id", "owner", "x.*")
    few = (F.col("n_owners") <= max_owners) & (F.lit(True) if max_docs is None else F.col("n_docs") <= max_docs)
    live = ownership(hits).where(few).select(F.col("hash").alias("live_hash"))
    told = hits.join(live, hits.hash == live.live_hash, "left").select("rid", "id", F.struct("start", "kind", "end").alias("span"), F.col("live_hash").isNotNull().alias("live"))
    kind = F.col("span.kind")
    keep = (kind < 3) | F.col("live")
    by_row = told.groupBy("rid").agg(
        F.first("id").alias("id"), *(F.count(F.when(kind == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.collect_list(F.when(kind < 3, F.col("span"))).alias("base"), F.collect_list(F.when(keep, F.col("span"))).alias("all"),
        F.count(F.when((kind < 3) & F.col("live"), 1)).alias("n_live"), F.count(F.when((kind < 3) & ~F.col("live"), 1)).alias("n_shared"),
    )
    counts = ["n_assign", "n_access", "n_hex"]
    out = by_row.select("id", *counts, _listed(F.col("base")).alias("base_spans"), _listed(F.col("all")).alias("spans"), "n_live", "n_shared")
    zero, empty = F.lit(0).cast("long"), F.lit("")
    rest = found.where((F.size("base") == 0) & (F.size("tokens") == 0))
    rest = rest.select("id", *(zero.alias(c) for c in counts), empty.alias("base_spans"), empty.alias("spans"), zero.alias("n_live"), zero.alias("n_shared"))
    return out.unionByName(rest).withColumnRenamed("id", id)


def _sql_matches(name: str, kind: int, pattern: str, group: int = 0, keep: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT rid, doc_id, owner, {kind} AS kind, s + sum(g) OVER w + sum(len_f) OVER w - len_f AS start, s + sum(g) OVER w + sum(len_f) OVER w AS stop, v FROM (
    SELECT rid, doc_id, owner, i, 0 AS s, length(gs[i]) AS g, length(fs[i]) AS len_f, vs[i] AS v FROM (
      SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM (
        SELECT rid, doc_id, owner, regexp_split_to_array(t, '{quoted}') AS gs, regexp_extract_all(t, '{quoted}') AS fs, regexp_extract_all(t, '{quoted}', {group}) AS vs FROM d) a) b) c
  WINDOW w AS (PARTITION BY rid ORDER BY i) QUALIFY {keep}
)"""


#: DuckDB's form of ``op6``'s columns.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS owner, coalesce(text, '') AS t FROM documents
), {_sql_matches("a0", 0, ASSIGN, 2, f"length(v) >= {MIN_ASSIGNED}")}, {_sql_matches("a1", 1, ACCESS)}, {_sql_matches("a2", 2, HEX)},
{_sql_matches("a3", 3, TOKEN, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")},
base AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2),
hits AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM a3 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = a3.rid AND b.start < a3.stop AND a3.start < b.stop)
), live AS (
  SELECT v FROM hits GROUP BY v HAVING count(DISTINCT coalesce(owner, chr(0))) <= {MAX_OWNERS}
), told AS (
  SELECT h.*, l.v IS NOT NULL AS is_live, ['{"', '".join(KINDS)}'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM hits h LEFT JOIN live l ON h.v = l.v
), r AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3 OR is_live) AS spans,
         count(*) FILTER (kind < 3 AND is_live) AS n_live, count(*) FILTER (kind < 3 AND NOT is_live) AS n_shared
  FROM told GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM d LEFT JOIN r USING (rid)
"""
