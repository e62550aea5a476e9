import pytest

from quernel.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_matches_duckdb(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


def test_every_operator_is_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert "pipeline" in known
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in known) == 1
