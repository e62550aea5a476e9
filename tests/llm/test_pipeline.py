import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from quernel.llm import quality
from quernel.llm.common import short_batches, stored


def test_stages_do_their_work(spark, sf):
    """Each stage against a plain version of itself, on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "source_mix", "packing"] and P.ORACLE_SQL is None
    kept = {r.doc_id for r in quality.score_quality(docs).where("kept").collect()}
    out = P.quality_rules(spark, docs, sf)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == kept and 0 < len(kept) < docs.count()

    lines = {r.doc_id: (r.text or "").split("\n") for r in out.collect()}
    holders: dict[str, set] = {}
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    for i, own in lines.items():
        for x in own:
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    want = {i: "\n".join(x for x in own if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i) for i, own in lines.items()}
    out = P.dedup_lines(spark, out, sf)
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())

    from tests.llm.test_similar import check_kept

    out = P.dedup_documents(spark, out, sf)
    assert out.columns == columns
    check_kept(want, {r.doc_id for r in out.collect()})

    before = out.toPandas()
    out = P.mix(spark, out, sf)
    after = out.toPandas()
    times = after.groupby("doc_id").size()
    assert out.columns == columns and times.max() <= 2 and set(after.doc_id) <= set(before.doc_id)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = before.text.map(words).sum()
    assert abs(after.text.map(words).sum() - 1.5 * total) < 20 * before.text.map(words).max()

    pieces = P.pack(spark, out, sf).toPandas()
    assert pieces.length.sum() == sum(n for n in pieces.groupby("doc_id").doc_tokens.first() * times)
    assert (np.log2(pieces.groupby("sequence_id").length.sum()) % 1 == 0).all()


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want, got = (sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect())) for df in (docs, P.run(spark, sf)))
    assert got == want and set(columns) <= set(docs.columns)


LINE = "A line that many documents hold, word by word"
_WORD = iter([a + b + c for a in ("ba", "lo", "mi", "tu") for b in ("ner", "vil", "sor", "ten", "ral") for c in ("a", "ing", "ed", "ous", "ly", "er", "al", "ic", "en", "um", "is", "o")])
PROSE = " ".join(f"The {next(_WORD)} of the {next(_WORD)} was {next(_WORD)} and {next(_WORD)} to {next(_WORD)} that have been with it." for _ in range(24))
ROWS = [
    (1, PROSE, "a"), (1, PROSE, "a"), (1, PROSE[::-1].replace(".", " the of and"), "a"), (2, PROSE + "\n" + LINE, "b"), (3, None, "a"), (4, "", None), (5, " \n", "a"), (6, LINE, "b"), (7, f"x\n{LINE}\n{LINE}", None),
    (None, PROSE + "\n" + LINE, None), (None, None, None), (8, " ".join(f"the long text of word{i} and that is" for i in range(30_000)), "c"),
]
CLASH = ("lines", "row", "node", "row_id", "n_lines", "copies", "m_id", "id", "u", "kept")


def test_stages_take_edge_rows(spark, sf):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASH})
    for name, stage in P.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, sf)
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r[c] == f"own {c}" for r in rows for c in CLASH) and (df is docs) == bool(rows), name
    kept = {(r.doc_id, r.text) for r in P.quality_rules(spark, docs, sf).collect()}
    assert (1, PROSE) in kept and not {i for i, t in kept} & {3, 4, 5}
    near = P.dedup_documents(spark, docs, sf).collect()
    assert sum(r.text == PROSE for r in near) == 1 and sum(r.doc_id == 1 for r in near) == 2 and sum(not (r.text or "").strip() for r in near) == 1
    lines = P.dedup_lines(spark, docs, sf).collect()
    assert sum((r.text or "").count(LINE) for r in lines if r.doc_id is not None) == 2 and sum(r.text is None for r in lines) == 2
    pieces = P.pack(spark, docs, sf).toPandas()
    assert pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum() and len(pieces[pieces.start == 0]) == len(ROWS)
    assert P.pack(spark, docs.limit(0), sf).count() == 0


def test_packing_is_bounded_in_memory(spark, monkeypatch):
    """Short batches of texts, and no more units remembered than the stage asks for, whatever the texts."""
    from types import SimpleNamespace

    import pyarrow as pa

    from quernel.llm import packing, similar, tokens

    key, asked = "spark.sql.execution.arrow.maxRecordsPerBatch", {}

    def seen(df, name):
        asked[name] = int(spark.conf.get(key))
        return stored(df, name)

    for module in (packing, similar):
        monkeypatch.setattr(module, "stored", seen)
    before = spark.conf.get(key)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert P.pack(spark, docs, "").count() >= 3000 and P.dedup_documents(spark, docs, "").count() == 3000
    assert asked["pieces"] <= 1024 and asked["distinct"] <= 1024 and spark.conf.get(key) == before
    rows = docs.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    with short_batches(spark, 100):
        assert max(r.n for r in rows.collect()) == 100

    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{i * 300 + j}x" for j in range(300)) for i in range(1000)]
    enc, sizes = tokens.encoder(packing.vocabulary(packing.MODEL)), []
    whole = enc.token_ids
    monkeypatch.setattr(enc, "token_ids", lambda *a: (whole(*a), sizes.append(len(enc.ids)))[0])
    run = packing._packing(packing.vocabulary, packing.MODEL, packing.TIERS, packing.STEP_TOKENS, 50_000)
    pieces = [n for b in run([pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": texts})]) for n in b.column("length").to_pylist()]
    assert max(sizes) <= 50_000 and sum(pieces) == sum(len(x) + 1 for x in tokens.Encoder(packing.vocabulary(packing.MODEL)).token_ids(texts))
    tokens.encoder.cache_clear()


def test_near_copies_leave_what_follows(spark, tmp_path, monkeypatch):
    """Of two near copies the smaller id alone is mixed and packed; with the stage left out both are."""
    text = lambda i, own: " ".join(f"The ba{i}x{k} of the lo{i}x{k} was mi{i}x{k or own} and tu{i}x{k} that have been with it." for k in range(24))
    rows = [(i, text(i % 12, "near" if i >= 12 else "first"), "en", "a", 0) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda: {r.doc_id for r in P.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert ids() == set(range(12))
    monkeypatch.setattr(P, "STAGES", [(n, (lambda s, docs, d: docs) if n == "simhash_dedup" else f) for n, f in P.STAGES])
    assert ids() == set(range(24))


def test_stages_begin_on_a_heap_given_back(spark, sf, monkeypatch):
    """What earlier work left on the heap is collected and returned to the system; each stage does so once, before anything else."""
    docs, runtime = spark.read.parquet(f"{sf}/documents.parquet"), spark._jvm.java.lang.Runtime.getRuntime()
    P.quality_rules(spark, docs, sf)
    assert spark.range(1).select(F.length(F.expr("repeat('x', 1500000000 + int(id))"))).first()[0] == 1_500_000_000
    grown = runtime.totalMemory()
    P.quality_rules(spark, docs, sf)
    assert runtime.totalMemory() < grown - 500_000_000

    done = []
    monkeypatch.setattr(P, "release_heap", lambda s: done.append("heap"))
    for module, work in ((P.quality, "keep_good"), (P.line_dedup, "drop_lines"), (P.similar, "keep_first"), (P.mixing, "take_mix"), (P.packing, "pack_documents")):
        monkeypatch.setattr(module, work, lambda docs, *a, work=work, **b: (done.append(work), docs)[1])
    for _, stage in P.STAGES:
        stage(spark, docs, sf)
    assert done == ["heap", "keep_good", "heap", "drop_lines", "heap", "keep_first", "heap", "take_mix", "heap", "pack_documents"]
