import pytest

from quernel import queries


@pytest.mark.parametrize("name", queries.QUERIES)
def test_matches_duckdb(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.SQL[name])


def test_property_filters_reach_the_scan(spark, sf, tmp_path):
    from quernel import fixtures
    from quernel.operators.properties import flatten
    from quernel.sources.store import EventStore

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    store = EventStore(spark, str(tmp_path / "s"))
    events = fixtures.envelopes(spark, sf)
    store.append_events(events, 0)
    store.append_properties(flatten(events), 0)
    plan = queries._BUILDER.events(queries.EventListQuery(**queries._SOURCE, **queries._WEEK, property_filters=queries._MULTI), store.events(), store.properties())
    text = plan.frame._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [isnotnull(route") == 2
    assert "LeftSemi" in text and text.count("GreaterThanOrEqual(event_time") >= 2 and "TakeOrderedAndProject" in text
    assert plan.frame.count() > 0
