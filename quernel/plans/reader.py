"""Queries over a store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quernel.model import CatalogQuery, EventCountQuery, EventListQuery, RealtimeQuery
from quernel.operators.properties import list_catalog
from quernel.plans.query import Plan, QueryBuilder
from quernel.sources.store import EventStore


@dataclass(frozen=True)
class EventReader:
    """Lists, counts, realtime pages and the catalog of one store; a source that it does not hold has no rows."""

    store: EventStore
    builder: QueryBuilder = QueryBuilder()

    def events(self, query: EventListQuery) -> Plan:
        return self.builder.events(query, self.store.events(), self.store.properties())

    def count(self, query: EventCountQuery) -> Plan:
        return self.builder.count(query, self.store.events(), self.store.properties())

    def realtime(self, query: RealtimeQuery) -> Plan:
        return self.builder.realtime(query, self.store.events(), self.store.properties())

    def catalog(self, query: CatalogQuery) -> DataFrame:
        return list_catalog(self.store.catalog(), query)
