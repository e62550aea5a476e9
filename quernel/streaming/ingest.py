"""Idempotent ingestion of messages, by micro-batch.

A batch is decoded, deduplicated in itself, handed to the handlers and written:
its events are claimed in the status table and appended, then their properties
with a status of their own, then the catalog, then dead letters. Each write
replaces the batch's own folders and a claim looks at earlier batches only, so
a replay after a break repairs the batch and changes nothing else. What a batch
reads of the history is the statuses of its own keys. No watermark: events may
be late by any time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.normalize import BAGS, FIELDS, bag_text
from quernel.operators.payload import computed, read, text_of, time_of
from quernel.operators.properties import build_catalog, flatten, merge_catalog, unflattenable
from quernel.schema import DEAD_LETTERS, EVENT_COLUMNS, EVENT_KEY
from quernel.sources.store import EventStore
from quernel.streaming.stats import BatchResult, Stats
from quernel.streaming.status import PROCESSING, PROPERTY_WRITES, Claim, claims, committed, refusal, rolled_back, started

MALFORMED = "malformed payload"
_TIMES = ("event_time", "received_at")


def decode(batch: DataFrame) -> DataFrame:
    """Messages to envelopes; ``decode_error`` says why one is none. Times are cut to milliseconds."""
    df = read(batch, "value", FIELDS, _TIMES, BAGS)
    part = lambda name: F.col("_p")[name]
    made = {c: F.coalesce(text_of(part(name)), F.lit("")) for name, c in FIELDS.items()}
    made |= {b: bag_text(part(b)) for b in BAGS} | {t: time_of(part(f"{t}_at"), millis=True) for t in _TIMES}
    df = computed(df, {c: made[c] for c in EVENT_COLUMNS})
    ids = [F.when(F.col(c) == "", F.lit(f"{c} is required")) for c in ("tenant_id", "project_id", "source_id", "event_id")]
    wrong = unflattenable(lambda bag: part(f"{bag}_entries"))
    return computed(df, {"decode_error": F.coalesce(F.when(~F.col("_p.well"), F.lit(MALFORMED)), *ids, wrong)}).drop("_p")


def first_of_each(envelopes: DataFrame) -> DataFrame:
    """One row per event key: the earliest by offset, or where messages have none by receipt, then by their text."""
    order = [c for c in (("partition", "offset") if "offset" in envelopes.columns else ("received_at", "value")) if c in envelopes.columns]
    rest = [c for c in envelopes.columns if c not in EVENT_KEY]
    best = F.min_by(F.struct(*rest), F.struct(*order) if order else F.lit(0)).alias("r")
    return envelopes.groupBy(*EVENT_KEY).agg(best).select(*EVENT_KEY, "r.*")


def not_stored(events: DataFrame, stored: DataFrame, batch_id: int) -> DataFrame:
    """Events whose key no earlier batch wrote; of the store, only their sources are read."""
    sources = events.select(*EVENT_KEY[:3]).distinct()
    old = stored.where(F.col("batch_id") < batch_id).join(sources, list(EVENT_KEY[:3]), "left_semi").select(*EVENT_KEY)
    return events.join(old, list(EVENT_KEY), "left_anti")


def _attempting(handler: Callable[[dict], None], attempts: int, backoff_s: float):
    """Column of each message's last error (null: it succeeded) and its attempts. Anything raised is a failure."""

    @F.pandas_udf("error string, attempt int")
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for message in messages.to_dict("records"):
            error, attempt = None, 0
            for attempt in range(1, max(1, attempts) + 1):
                try:
                    handler(message)
                    error = None
                    break
                except Exception as e:
                    if attempts <= 0:
                        raise
                    error = str(e)
                    if attempt < attempts:
                        time.sleep(backoff_s)
            rows.append((error, attempt))
        return pd.DataFrame(rows, columns=["error", "attempt"])

    return run


@dataclass
class Ingest:
    """``foreachBatch`` function that writes to a store.

    With ``max_attempts`` of zero nothing becomes a dead letter after attempts:
    an error ends the stream, which replays the batch when it starts again.
    """

    store: EventStore
    consumer_group: str = "ingestion"
    consumer_id: str = "quernel"
    max_attempts: int = 5
    backoff_s: float = 0.25
    index_properties: bool = True
    catalog: bool = True
    #: Called with (events, batch id) before events are written; an error is retried, then the batch goes to the dead letters.
    handler: Callable[[DataFrame, int], None] | None = None
    #: Called with each message (a dict of its envelope) where it lies; one that keeps failing goes to the dead letters alone.
    message_handler: Callable[[dict], None] | None = None
    #: Also takes the dead letters, as a topic's writer does; tried until it succeeds.
    dead_letter_sink: Callable[[DataFrame], None] | None = None
    #: UTC without a zone.
    now: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None)
    stats: Stats = field(default_factory=Stats)
    last: BatchResult | None = None

    def __post_init__(self):
        for value, what in ((self.consumer_group, "consumer group name"), (self.consumer_id, "consumer name"), (self.store, "event store")):
            if not value:
                raise ValueError(f"{what} is required")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.last, self._held = BatchResult(batch_id), []
        now = F.lit(self.now().isoformat(sep=" ")).cast("timestamp_ntz")
        try:
            decoded = self._kept(decode(batch))
            bad = decoded.where("decode_error IS NOT NULL")
            counts = {r.e: r.n for r in decoded.groupBy(F.coalesce(F.col("decode_error") == MALFORMED, F.lit(False)).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}
            self._count(consumed=sum(counts.values()), malformed=counts.get(True, 0))
            good = first_of_each(decoded.where("decode_error IS NULL"))
            dead = [self._dead(bad, F.lit(1), F.col("decode_error"), now)]
            good = self._handled(good, batch_id, dead, now)
            good = self._events(good, batch_id, dead, now)
            if self.index_properties:
                self._properties(good, batch_id, dead, now)
            if self.catalog:
                new = self._kept(build_catalog(flatten(good)))
                self._count(catalog_entries=new.count())
                self.store.write_catalog(merge_catalog(self.store.catalog(before=batch_id), new), batch_id)
            self._bury(self._kept(reduce(DataFrame.unionByName, dead)), batch_id)
            self.stats.add(self.last)
        finally:
            for df in self._held:
                df.unpersist()

    def _kept(self, df: DataFrame) -> DataFrame:
        """Read several times in this batch. A lost part is computed again, with the same result."""
        self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def _count(self, **more: int) -> None:
        self.last = replace(self.last, **{k: getattr(self.last, k) + n for k, n in more.items()})

    def _retried(self, action: Callable[[], None]) -> str | None:
        """The last error, or None once an attempt succeeds."""
        for attempt in range(1, max(1, self.max_attempts) + 1):
            try:
                action()
                return None
            except Exception as e:
                self._count(failures=1)
                if self.max_attempts <= 0:
                    raise
                error = str(e)
                if attempt < self.max_attempts:
                    self._count(retries=1)
                    time.sleep(self.backoff_s)
        return error

    def _handled(self, good: DataFrame, batch_id: int, dead: list[DataFrame], now: Column) -> DataFrame:
        """The messages that the handlers took."""
        if self.message_handler is not None:
            told = _attempting(self.message_handler, self.max_attempts, self.backoff_s)
            # The outcome is kept: reading it again does not call the handler again, unless an executor is lost.
            tried = self._kept(computed(good, {"_o": told(F.struct(*EVENT_COLUMNS))}))
            failed = tried.where("_o.error IS NOT NULL")
            dead.append(self._dead(failed, F.col("_o.attempt"), F.col("_o.error"), now))
            again = tried.agg(F.sum(F.col("_o.attempt") - 1), F.count(F.when(F.col("_o.error").isNotNull(), 1))).first()
            self._count(retries=again[0] or 0, failures=(again[0] or 0) + again[1])
            good = tried.where("_o.error IS NULL").drop("_o")
        if self.handler is not None and (error := self._retried(lambda: self.handler(good, batch_id))) is not None:
            dead.append(self._dead(good, F.lit(self.max_attempts), F.lit(error), now))
            return good.limit(0)
        return good

    def _events(self, good: DataFrame, batch_id: int, dead: list[DataFrame], now: Column) -> DataFrame:
        """Appends what is new; returns the events that are stored now, duplicates of earlier ones among them."""
        store, key = self.store, list(EVENT_KEY)
        claimed = store.worked(claims(store.status("event_status", good, before=batch_id), good), "event_claims")
        begun = started(claimed, now)
        store.append(begun, "event_status", batch_id)
        fresh = good.join(begun.select(*key), key, "left_semi")
        open_ = claimed.where(F.col("old_status") == PROCESSING)
        if not open_.isEmpty():  # an earlier batch broke off: it may have written these
            fresh = not_stored(fresh, store.events(), batch_id)
        error = self._retried(lambda: store.append_events(fresh, batch_id))
        store.append(committed(begun, now) if error is None else rolled_back(begun, error, now), "event_status", batch_id)
        n = {r.claim: r.n for r in claimed.groupBy("claim").agg(F.count(F.lit(1)).alias("n")).collect()}
        self._count(duplicates=n.get(Claim.SKIP, 0))
        if error is None:
            self._count(inserted=n.get(Claim.NEW, 0) + n.get(Claim.AGAIN, 0))
            return good
        dead.append(self._dead(fresh, F.lit(self.max_attempts), F.lit(error), now))
        return good.join(begun.select(*key), key, "left_anti")

    def _properties(self, good: DataFrame, batch_id: int, dead: list[DataFrame], now: Column) -> None:
        """Properties have a status of their own: an event whose properties are missing gets them now."""
        store, key = self.store, list(EVENT_KEY)
        claimed = store.worked(claims(store.status("property_status", good, before=batch_id), good, PROPERTY_WRITES), "property_claims")
        begun = started(claimed, now)
        store.append(begun, "property_status", batch_id)
        fresh = good.join(begun.select(*key), key, "left_semi")
        rows = self._kept(flatten(fresh))
        error = self._retried(lambda: store.append_properties(rows, batch_id))
        store.append(committed(begun, now) if error is None else rolled_back(begun, error, now), "property_status", batch_id)
        refused = claimed.where(F.col("claim") == Claim.REFUSED).select(*key, refusal().alias("_why"))
        dead.append(self._dead(good.join(refused, key), F.lit(max(1, self.max_attempts)), F.col("_why"), now))
        if error is None:
            self._count(property_rows=rows.count())
        else:
            dead.append(self._dead(fresh, F.lit(self.max_attempts), F.lit(error), now))

    def _dead(self, rows: DataFrame, attempt: Column, error: Column, now: Column) -> DataFrame:
        """Dead letters: ``raw`` holds what could not be decoded, ``envelope`` what could."""
        has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        value, broken = F.col("value"), error == MALFORMED
        return rows.select(
            F.when(~broken, value).alias("envelope"), F.when(broken, value).alias("raw"), has("topic", "string").alias("original_topic"), has("partition", "int").alias("original_partition"),
            has("offset", "long").alias("original_offset"), has("key", "string").alias("original_key"), F.lit(self.consumer_group).alias("consumer_group"), F.lit(self.consumer_id).alias("consumer_id"),
            attempt.cast("int").alias("attempt"), error.alias("error"), now.alias("failed_at"),
        ).select(*DEAD_LETTERS.fieldNames())

    def _bury(self, dead: DataFrame, batch_id: int) -> None:
        self._count(dead_letters=dead.count())
        self.store.append_dead_letters(dead, batch_id)
        while self.dead_letter_sink is not None:
            try:
                return self.dead_letter_sink(dead)
            except Exception:
                self._count(failures=1)
                if self.max_attempts <= 0:
                    raise
                time.sleep(self.backoff_s)


def run(source: DataFrame, ingest: Ingest, checkpoint: str, available_now: bool = True, seconds: int = 10):
    """Starts the stream: all that is there, or every ``seconds``."""
    writer = source.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()
