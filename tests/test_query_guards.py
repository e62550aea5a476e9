from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from quernel.model import EventFilter, EventListQuery, Family, InvalidEventQuery, Policy, PropertyFilter, RealtimeQuery
from quernel.plans.query import QueryBuilder

T0 = datetime(2026, 5, 1)
BASE = EventListQuery("t", "p", "s", since=T0, until=T0 + timedelta(days=7))
PROP = PropertyFilter("event", "button", "string", "eq", "hero")
BUILDER = QueryBuilder(Policy(allowed_properties=frozenset({("event", "button")})))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"offset": -1}, "offset must be non-negative"),
        ({"until": T0}, "from must be before to"),
        ({"filters": (EventFilter("event_name", "eq", "x"),) * 21}, "too many event filters: 21 > 20"),
        ({"since": None, "property_filters": (PROP,)}, "property filters require bounded from and to"),
        ({"until": T0 + timedelta(days=7, seconds=1), "property_filters": (PROP,)}, "property-filter time window 168h0m1s exceeds max 168h0m0s"),
        ({"tenant_id": ""}, "tenant_id is required"),
        ({"project_id": ""}, "project_id is required"),
        ({"source_id": ""}, "source_id is required"),
        ({"filters": (EventFilter("nope", "eq", "x"),)}, 'unsupported events filter field "nope"'),
        ({"filters": (EventFilter("event_name", "like", "x"),)}, 'unsupported events filter operator "like"'),
        ({"filters": (EventFilter("event_name", "eq", ""),)}, "event filter 0 value is required"),
        ({"property_filters": (replace(PROP, name=" "),)}, "property filter 0 property name is required"),
        ({"property_filters": (replace(PROP, scope="x"),)}, 'unsupported property scope "x"'),
        ({"property_filters": (replace(PROP, name="other"),)}, "property filter 0 event.other is not allowlisted"),
        ({"property_filters": (replace(PROP, op="gt"),)}, 'unsupported events filter operator "gt"'),
        ({"property_filters": (replace(PROP, value_type="null", op="neq"),)}, "property filter 0 null only supports eq"),
        ({"property_filters": (replace(PROP, value_type="date"),)}, 'unsupported property value type "date"'),
        ({"sort_field": "x"}, 'unsupported events sort field "x"'),
        ({"sort_direction": "up"}, 'unsupported events sort direction "up"'),
        ({"offset": -1, "tenant_id": ""}, "offset must be non-negative"),
    ],
)
def test_refused_before_spark(change, message):
    with pytest.raises(InvalidEventQuery, match="^invalid event query: ") as e:
        BUILDER.events(replace(BASE, **change), None, None)
    assert message in str(e.value)


def test_policy_is_checked():
    for bad in ({"max_limit": 0}, {"max_filters": 0}, {"max_property_window": timedelta(0)}, {"allowed_properties": None}):
        with pytest.raises(ValueError):
            Policy(**bad)


def test_evidence_has_no_values(spark, sf):
    from quernel import fixtures
    from quernel.operators.properties import flatten

    events = fixtures.envelopes(spark, sf)
    plan = BUILDER.events(
        replace(BASE, event_name="secret-name", filters=(EventFilter("visit_id", "neq", "secret-visit"),), property_filters=(replace(PROP, name=" button "),), limit=5000, offset=3),
        events, flatten(events),
    )
    e = plan.evidence
    assert (e.family, e.effective_limit, e.offset, e.scalar_filters, e.window_seconds, e.uses_property_table) == (Family.EVENTS, 1000, 3, 4, 604800, True)
    assert e.property_filters[0].name == "button" and "secret" not in repr(e) and "hero" not in repr(e)
    assert BUILDER.realtime(RealtimeQuery("t", "p", "s"), events, flatten(events)).evidence.effective_limit == 50


def test_query_level_allowlist_and_exact_window(spark, sf):
    from quernel import fixtures
    from quernel.operators.properties import flatten

    events = fixtures.envelopes(spark, sf)
    spec = replace(BASE, property_filters=(replace(PROP, scope="user", name="plan"),), allowed_properties=(("user", " plan "), ("bad", "x")))
    assert BUILDER.events(spec, events, flatten(events)).frame.count() == 0


def test_duplicate_property_rows_do_not_multiply(spark):
    from quernel import fixtures

    events, props = fixtures.bench_events(spark, 200), fixtures.bench_properties(spark, 200)
    spec = EventListQuery("tenant_1", "project_1", "source_1", since=datetime(2026, 5, 1), until=datetime(2026, 5, 2), property_filters=(PROP,))
    assert BUILDER.events(spec, events, props.unionByName(props)).frame.count() == 2
