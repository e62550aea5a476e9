"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a word target: its weight's share of the budget, cut at
``max_repeat`` times its size, the excess dealt again by weight. A document is
taken ``target / size of its source`` times on average: some whole copies, and
a fraction that is rounded. Fractions are rounded dependently: two documents
meet, and a random one takes mass (words) from the other until one of the two
is whole; the other goes on to the next. Expected copies stay what they were
and the words of the pair are kept exactly, so a source misses its target by
less than one document.

Documents are dealt to small groups of their source by a hash of their id;
each group leaves one unfinished document, the leftovers form groups again,
and so on: a reduction tree whose levels shrink by ``GROUP``. Nothing larger
than a group meets in one place, a hot source only has more groups. Groups are
worked from long to short documents, so what is left over tends to be short.

Built-in functions only. All random draws are hashes of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import count_words, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEAT = 2.0
#: Documents in a group, on average.
GROUP = 64
SEED = 7


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) to the same with ``target``.

    The table has a row per source. Ranking it takes one window over that
    table; the capped shares come from sums alone: a round frees the words of
    sources above their cap and shares out what is left among the others,
    until no source is above.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    table = stored(sizes.withColumn("w", weight).withColumn("cap", F.lit(max_repeat) * F.col("source_size")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate, above = None, 0
    while True:
        capped = F.lit(False) if rate is None else F.col("cap") < F.col("w") * F.lit(rate)
        sums = table.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w"))), F.count(F.when(capped, 1))).first()
        if rate is not None and (sums[2] == above or not sums[1]):
            break
        above, rate = sums[2], (budget * total - (sums[0] or 0.0)) / (sums[1] or 1.0)
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(rate)).alias("target"))


def _draw(*of: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 52)).cast("double") / float(1 << 52)


_UNIT = "struct<words:bigint,id:bigint,p:double,whole:bigint,n:bigint>"


def _unit(x: Column, p: Column) -> Column:
    return F.struct(x["words"].alias("words"), x["id"].alias("id"), p.alias("p"), x["whole"].alias("whole"), x["n"].alias("n")).cast(_UNIT)


def _meet(a: Column, b: Column, draw: Column) -> tuple[Column, Column]:
    """(finished, unfinished) after mass moved between ``a`` and ``b``.

    ``up`` is what ``a`` can take before it or ``b`` is whole, ``down`` what
    ``b`` can; ``a`` takes with probability down / (up + down), which leaves
    the expectations as they are.
    """
    wa, wb = a["words"].cast("double"), b["words"].cast("double")
    fill_a, drain_b = wa * (1 - a["p"]), wb * b["p"]
    fill_b, drain_a = wb * (1 - b["p"]), wa * a["p"]
    up, down = F.least(fill_a, drain_b), F.least(fill_b, drain_a)
    rises = draw * (up + down) < down
    a_done = F.when(rises, fill_a <= drain_b).otherwise(drain_a <= fill_b)
    a_end = F.when(rises, F.lit(1.0)).otherwise(0.0)
    unit = lambda x, p: _unit(x, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    a_left = unit(a, F.when(rises, a["p"] + drain_b / wa).otherwise(a["p"] - fill_b / wa))
    b_left = unit(b, F.when(rises, b["p"] - fill_a / wb).otherwise(b["p"] + drain_a / wb))
    done = F.when(a_done, _unit(a, a_end)).otherwise(_unit(b, 1.0 - a_end))
    return done, F.when(a_done, b_left).otherwise(a_left)


def _round_group(units: Column, level: int) -> Column:
    """Finished units and the one left of a sorted, non-empty array of fractional units."""
    none = F.array().cast(f"array<{_UNIT}>")

    def step(acc: Column, x: Column) -> Column:
        done, left = _meet(acc["left"], x, _draw(F.lit(level), acc["left"]["id"], x["id"], acc["left"]["words"]))
        # A unit that became whole by both ends at once needs no partner: it is kept as it is, with p 0 or 1.
        whole = (acc["left"]["p"] <= 0) | (acc["left"]["p"] >= 1)
        out = F.concat(acc["done"], F.array(F.when(whole, acc["left"]).otherwise(done)))
        return F.struct(F.when(whole, x).otherwise(left).cast(_UNIT).alias("left"), out.cast(f"array<{_UNIT}>").alias("done"))

    start = F.struct(F.element_at(units, 1).cast(_UNIT).alias("left"), none.alias("done"))
    return F.aggregate(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT, group: int = GROUP) -> DataFrame:
    """One row per row: id, size, source, source_size, target, copies, taken.

    ``size`` is the number of words, ``taken`` = copies * size. A null text has
    no words and is taken zero times. A null source is a source of its own,
    last in order. Rows that agree in id, source and size are one unit with one
    outcome, so repeated rows agree; null ids are units of their own per source
    and size. Texts may be of any length, further columns are ignored, an empty
    table gives an empty one. The same rows give the same result in any order or
    partitioning.
    """
    sized = docs.select(F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size"))
    units = stored(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    totals = stored(totals, "totals")
    targets = source_targets(totals.select("source", "source_size"), weights, budget, max_repeat)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_units") / group)).cast("long").alias("buckets")
    # One row per source; adaptive execution decides by measured size whether it is broadcast.
    per_source = targets.alias("t").join(totals.alias("n"), F.expr("t.source <=> n.source")).select("t.source", "t.source_size", "target", buckets)
    per_source = stored(per_source, "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = units.alias("u").join(per_source.alias("s"), F.expr("u.source <=> s.source")).select("u.id", "u.source", "u.size", "u.n", "buckets", rate.alias("rate"))
    whole = F.floor(F.col("rate") + 1e-12).cast("long")
    dealt = joined.select(
        "source", F.pmod(F.xxhash64(F.lit(SEED), "id", "size"), F.col("buckets")).alias("bucket"),
        F.struct((F.col("size") * F.col("n")).alias("words"), "id", F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"), whole.alias("whole"), "n").cast(_UNIT).alias("u"),
    )
    # Without words, or without a fraction, there is nothing to round.
    still = (F.col("u.words") > 0) & (F.col("u.p") > 1e-12)
    settled = [dealt.where(~still).select("source", _unit(F.col("u"), F.lit(0.0)).alias("u"))]
    open_, level, most = dealt.where(still).select("source", "bucket", "u"), 0, totals.agg(F.max(F.ceil(F.col("n_units") / group))).first()[0] or 0
    while most:
        grouped = open_.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("u"), asc=False).alias("units"))
        done = stored(grouped.select("source", "bucket", _round_group(F.col("units"), level).alias("r")), "rounded")
        settled.append(done.select("source", F.explode("r.done").alias("u")))
        level, last = level + 1, most <= 1
        left = done.select("source", F.floor(F.col("bucket") / group).alias("bucket"), F.col("r.left").alias("u"))
        if last:
            settled.append(left.select("source", "u"))
            break
        open_, most = left, -(-most // group)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    copy = F.col("u.whole") + (_draw(F.lit(-1), F.col("u.id"), F.col("u.words")) < F.col("u.p")).cast("long")
    size = F.when(F.col("u.n") > 0, F.col("u.words") / F.col("u.n")).cast("long")
    flat = out.select("source", F.col("u.id").alias("id"), size.alias("size"), copy.alias("copies"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("u.n"))).alias("_one"))
    final = flat.alias("f").join(per_source.alias("s"), F.expr("f.source <=> s.source"))
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0).cast("long"))
    return final.select(F.col("f.id").alias("id"), "size", "f.source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    Nulls, repeats, ties and empty tables as in ``mix_sources``; texts may be of
    any length, and columns may have any names. Copies are looked up by id and
    source in a written table, by one shuffle of the rows at any size; words are
    counted again only where rows share both and differ in size.
    """
    mix = mix_sources(docs, id, text, source, **options).select(F.col("id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "copies")
    mix = stored(mix.distinct(), "mix")
    alike = not mix.groupBy("m_id", "m_source").count().where("count > 1").isEmpty()
    size = count_words(F.col(text)) if alike else F.lit(None).cast("long")
    row = docs.select(F.struct("*").alias("row"), F.col(id).cast("long").alias("r_id"), F.col(source).cast("string").alias("r_source"), size.alias("r_size"))
    kept = row.join(mix.where("copies > 0").hint("merge"), F.expr("r_id <=> m_id AND r_source <=> m_source" + (" AND r_size = m_size" if alike else "")))
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("row.*")
