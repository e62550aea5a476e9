"""Checkpoints of event and property writes: claim, commit, roll back.

Statuses are a small keyed table; each step takes the old table and gives the
rows that change. Events that failed or are still in progress may be claimed
again; of property writes only failed ones, as one in progress may have
written.
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import cut_bytes
from quernel.schema import EVENT_KEY, STATUS

PROCESSING, INSERTED, FAILED = "processing", "inserted", "failed"


class Claim(StrEnum):
    NEW = "new"
    AGAIN = "again"
    SKIP = "skip"
    REFUSED = "refused"


#: Which existing statuses can be claimed again.
EVENT_WRITES = frozenset({PROCESSING, FAILED})
PROPERTY_WRITES = frozenset({FAILED})


def claims(status: DataFrame, incoming: DataFrame, reclaimable: frozenset[str] = EVENT_WRITES) -> DataFrame:
    """One row per incoming key: the key, ``received_at``, ``claim``, and the old attempt, status and creation time."""
    keys = incoming.groupBy(*EVENT_KEY).agg(F.min("received_at").alias("received_at"))
    old = status.select(
        *(F.col(c).alias(f"s_{c}") for c in EVENT_KEY), F.col("status").alias("old_status"), F.col("attempt").alias("s_attempt"),
        F.col("created_at").alias("old_created"),
    )
    joined = keys.join(old, [keys[c] == old[f"s_{c}"] for c in EVENT_KEY], "left")
    was = F.col("old_status")
    claim = F.when(was.isNull(), Claim.NEW).when(was == INSERTED, Claim.SKIP).when(was.isin(*reclaimable), Claim.AGAIN).otherwise(Claim.REFUSED)
    return joined.select(*EVENT_KEY, "received_at", claim.alias("claim"), F.coalesce("s_attempt", F.lit(0)).alias("attempt"), "old_status", "old_created")


def refusal(what: str = "property indexing") -> Column:
    """Why a refused claim can't be taken."""
    return F.concat(F.lit(f'{what} status "'), F.col("old_status"), F.lit('" is not reclaimable'))


def started(claimed: DataFrame, now: Column) -> DataFrame:
    """Rows of the new and repeated claims: in progress, one attempt more, no error."""
    begun = claimed.where(F.col("claim").isin(Claim.NEW, Claim.AGAIN))
    columns = {
        "status": F.lit(PROCESSING), "attempt": (F.col("attempt") + 1).cast("int"), "last_error": F.lit(""), "created_at": F.coalesce("old_created", now),
        "updated_at": now,
    }
    return begun.withColumns(columns).select(*STATUS.fieldNames())


def committed(rows: DataFrame, now: Column) -> DataFrame:
    """Claimed rows whose write succeeded."""
    return rows.withColumns({"status": F.lit(INSERTED), "last_error": F.lit(""), "updated_at": now})


def rolled_back(rows: DataFrame, error: str, now: Column) -> DataFrame:
    """Claimed rows whose write failed; what is written already stays written."""
    return rows.where(F.col("status") != INSERTED).withColumns({"status": F.lit(FAILED), "last_error": cut_bytes(F.lit(error)), "updated_at": now})


def applied(status: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole table after some of its rows changed or came to it."""
    rest = status.join(rows.select(*EVENT_KEY), list(EVENT_KEY), "left_anti").select(*STATUS.fieldNames())
    return rest.unionByName(rows.select(*STATUS.fieldNames()))


def latest(log: DataFrame) -> DataFrame:
    """The current row of each key of a log whose rows carry the batch that wrote them."""
    rest = [c for c in STATUS.fieldNames() if c not in EVENT_KEY]
    return log.groupBy(*EVENT_KEY).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*EVENT_KEY, "r.*")
