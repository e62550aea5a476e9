"""Registered queries without a SQL form, on the whole documents table, against plain versions of themselves."""

import re

import pytest

from quernel.llm import queries
from tests.llm.test_edges import _ids, brute_components, brute_fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def test_op2(spark, sf, table):
    got = queries.QUERIES["op2_source_mix"](spark, sf).toPandas().set_index("doc_id")
    size = table.set_index("doc_id").text.map(lambda t: len(WORD.findall(t or "")))
    assert (got["size"].sort_index() == size.sort_index()).all() and len(got) == len(table)
    by = size.groupby(table.set_index("doc_id").source.rename("source")).sum().sort_index()
    weights = [(5, 2, 1)[i % 3] for i in range(len(by))]
    total, capped = 1.5 * size.sum(), set()
    while True:  # water filling: what is above its cap leaves the sharing
        rate = (total - sum(2 * by.iloc[i] for i in capped)) / max(1, sum(w for i, w in enumerate(weights) if i not in capped))
        over = {i for i, w in enumerate(weights) if i not in capped and w * rate > 2 * by.iloc[i]}
        if not over:
            break
        capped |= over
    target = {s: 2 * by.iloc[i] if i in capped else weights[i] * rate for i, s in enumerate(by.index)}
    for source, rows in got.groupby("source"):
        assert rows.source_size.unique().tolist() == [by[source]] and abs(rows.target - target[source]).max() < 1e-6 * target[source]
        assert abs(rows.taken.sum() - target[source]) <= rows["size"].max()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()


def test_op5(spark, sf, table):
    got = queries.QUERIES["op5_simhash"](spark, sf).toPandas().set_index("doc_id")
    fps = [brute_fingerprint(t, 4) for t in table.text]
    roots = brute_components(fps, 4)
    least: dict[int, int] = {}
    for i, r in zip(table.doc_id, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    for i, fp, r in zip(table.doc_id, fps, roots, strict=True):
        assert (got.fingerprint[i], got.component_id[i]) == (f"{fp:016x}", least[r])


def test_op7(spark, sf, table):
    from tests.llm.test_edges import check_packing

    rows = queries.QUERIES["op7_packing"](spark, sf).collect()
    check_packing(rows, dict(zip(table.doc_id, table.text, strict=True)))


def test_op8(spark, sf, table):
    ids = _ids()
    got = queries.QUERIES["op8_token_counts"](spark, sf).toPandas().set_index("doc_id")
    for i, text in zip(table.doc_id, table.text, strict=True):
        n = len(ids(text))
        assert (got.n_bytes[i], got.n_tokens[i], got.over_limit[i]) == (len((text or "").encode()), n, n > 1024)
