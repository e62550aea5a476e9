"""Parquet tables of one store root.

Events and properties are partitioned by route and day, so a query opens the
folders of its source and its days; a batch has a folder of its own below each,
which its replay replaces. ``compact`` merges the folders of finished batches
into runs, sorted and cut by range, and ``vacuum`` removes what runs replaced.

Statuses are logs of changed rows, partitioned by a bucket of the key's hash:
a batch reads the buckets that it holds keys of, and of them the keys only that
it asks for. Compaction keeps the current row of each key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel import schema as S
from quernel.streaming.status import latest

#: Partition columns of each table, without the batch.
PARTITIONS = {"events": ("route", "day"), "properties": ("route", "day"), "event_status": ("bucket",), "property_status": ("bucket",), "dead_letters": ()}
SCHEMAS = {"events": S.EVENTS, "properties": S.PROPERTIES, "event_status": S.STATUS, "property_status": S.STATUS, "dead_letters": S.DEAD_LETTERS}
ORDERS = {
    "events": ("event_time", "visit_id", "event_id"), "properties": ("property_scope", "property_name", "event_time", "visit_id", "event_id"),
    "event_status": S.EVENT_KEY, "property_status": S.EVENT_KEY, "dead_letters": ("original_partition", "original_offset"),
}
_TYPES = {"route": T.StringType(), "day": T.DateType(), "bucket": T.IntegerType(), "batch_id": T.LongType()}


@dataclass(frozen=True)
class EventStore:
    """Event, property, catalog, dead-letter and status tables below ``root``.

    A batch owns its folders: writing it again replaces them, so a batch that
    broke off half-way is repaired by its replay.
    """

    spark: SparkSession
    root: str
    prefix: str = "events"
    #: Buckets of the status tables; fixed once a store has any.
    buckets: int = 32

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    # Files.

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _finished(self, folder: str, name: str) -> list[int]:
        """Numbers of the complete ``name=...`` tables in a folder."""
        fs, path = self._fs(folder)
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix(f"{name}=")) for p in done if p.getName().startswith(f"{name}="))

    def create(self) -> None:
        """Makes the folders that are missing; what is there stays."""
        for table in (*SCHEMAS, "catalog"):
            fs, path = self._fs(self.path(table))
            fs.mkdirs(path)

    # Reads.

    def _parquet(self, path: str, schema: T.StructType) -> DataFrame:
        """The table, or no rows where it does not exist yet."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        """All rows of finished batches, with the table's partition columns and ``batch_id``."""
        fields, parts = SCHEMAS[table].fields, PARTITIONS[table]
        part_fields = [T.StructField(c, _TYPES[c]) for c in parts]
        batch = T.StructField("batch_id", _TYPES["batch_id"])
        live = self._parquet(f"{self.path(table)}/live", T.StructType([*fields, *part_fields, batch]))
        runs = self._finished(f"{self.path(table)}/runs", "run")
        if not runs:
            return live
        out = live.where(F.col("batch_id") > runs[-1])
        for run in runs:
            out = out.unionByName(self._parquet(f"{self.path(table)}/runs/run={run}", T.StructType([*fields, batch, *part_fields])))
        return out

    def events(self) -> DataFrame:
        return self.read("events")

    def properties(self) -> DataFrame:
        return self.read("properties")

    def dead_letters(self) -> DataFrame:
        return self.read("dead_letters")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*S.EVENT_KEY), F.lit(self.buckets)).cast("int")

    def status(self, table: str, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The current status of each key, or of ``keys`` only, as it was before a batch."""
        log = self.read(table)
        if before is not None:
            log = log.where(F.col("batch_id") < before)
        if keys is not None:
            asked = keys.select(*S.EVENT_KEY, self.bucket().alias("bucket")).distinct()
            held = [r.bucket for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets
            log = log.where(F.col("bucket").isin(held)).join(asked, ["bucket", *S.EVENT_KEY], "left_semi")
        return latest(log)

    # Writes.

    def _keyed(self, df: DataFrame, table: str) -> DataFrame:
        made = {"route": S.route(self.prefix), "day": F.col("event_time").cast("date"), "bucket": self.bucket()}
        return df.select(*SCHEMAS[table].fieldNames(), *(made[c].alias(c) for c in PARTITIONS[table]))

    def append(self, df: DataFrame, table: str, batch_id: int) -> None:
        """Writes a batch's rows of a table in place of what the batch wrote before."""
        parts, order = PARTITIONS[table], ORDERS[table]
        out = self._keyed(df, table).withColumn("batch_id", F.lit(batch_id).cast("long"))
        if parts:
            out = out.repartitionByRange(*parts, *order)  # a folder's rows meet, a large one is cut
        out = out.sortWithinPartitions(*parts, *order)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch_id").parquet(f"{self.path(table)}/live")

    def append_events(self, events: DataFrame, batch_id: int) -> None:
        self.append(events, "events", batch_id)

    def append_properties(self, rows: DataFrame, batch_id: int) -> None:
        self.append(rows, "properties", batch_id)

    def append_dead_letters(self, rows: DataFrame, batch_id: int) -> None:
        self.append(rows, "dead_letters", batch_id)

    def worked(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of the running batch, which the next one replaces: what depends on it is not computed from the store again."""
        df.write.mode("overwrite").parquet(f"{self.path('work')}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path('work')}/{name}")

    def compact(self, table: str, last: int) -> None:
        """Merges the live batches up to ``last`` into one run. They have to be finished: a later replay of one would be lost."""
        runs = self._finished(f"{self.path(table)}/runs", "run")
        if runs and last <= runs[-1]:
            return
        parts, order = PARTITIONS[table], ORDERS[table]
        rows = self.read(table).where((F.col("batch_id") > (runs[-1] if runs else -1)) & (F.col("batch_id") <= last))
        if table.endswith("_status"):
            rest = [c for c in rows.columns if c not in S.EVENT_KEY]
            rows = rows.groupBy(*S.EVENT_KEY).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*S.EVENT_KEY, "r.*").select(*rows.columns)
        rows = rows.repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{self.path(table)}/runs/run={last}")

    def vacuum(self, table: str) -> None:
        """Removes live folders that a run replaced."""
        runs = self._finished(f"{self.path(table)}/runs", "run")
        fs, live = self._fs(f"{self.path(table)}/live")
        if not runs or not fs.exists(live):
            return
        folders = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(live, "/".join(["*"] * len(PARTITIONS[table]) + ["batch_id=*"])))
        for path in [f.getPath() for f in folders]:
            if int(path.getName().removeprefix("batch_id=")) <= runs[-1]:
                fs.delete(path, True)

    # The catalog is small; each batch writes a version and the newest complete one counts.

    def catalog(self, before: int | None = None) -> DataFrame:
        versions = [v for v in self._finished(self.path("catalog"), "version") if before is None or v < before]
        if not versions:
            return self.spark.createDataFrame([], S.CATALOG)
        return self.spark.read.schema(S.CATALOG).parquet(f"{self.path('catalog')}/version={versions[-1]}")

    def write_catalog(self, merged: DataFrame, version: int) -> None:
        merged.write.mode("overwrite").parquet(f"{self.path('catalog')}/version={version}")
