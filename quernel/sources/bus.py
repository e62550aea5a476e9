"""Message sources and sinks: collect landings, files, Kafka.

A message has ``key`` and ``value`` (an envelope as JSON) and, from queues,
topic, partition and offset.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.text import client_ip, trimmed
from quernel.schema import DEAD_LETTERS, EVENT_COLUMNS

#: JSON names of the envelope, in the order of the event table's columns.
_JSON = {c: ("id" if c == "event_id" else c) for c in EVENT_COLUMNS}
_LANDING = "raw string, method string, user_agent string, referer string, forwarded_for string, real_ip string, peer string, received_at timestamp_ntz"


def collect_landing(spark: SparkSession, path: str, trust_proxy: bool = False, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Landed HTTP requests as ``raw``, ``received_at`` and client columns; only POST passes, ``method_status`` 405 marks the others for ``with_status``."""
    reader = (spark.readStream if stream else spark.read).schema(_LANDING)
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.json(path)
    return df.select(
        "raw", "received_at", F.when(F.coalesce(F.col("method"), F.lit("POST")) != "POST", 405).alias("method_status"),
        trimmed(F.col("user_agent")).alias("user_agent"), trimmed(F.col("referer")).alias("referrer"), client_ip(
            F.col("forwarded_for"), F.col("real_ip"), F.col("peer"), trust_proxy,
        ).alias("ip"),
    )


def event_key() -> Column:
    """tenant:project:source, else the event's id, else its name."""
    scope = F.concat_ws(":", *(F.coalesce(F.col(c), F.lit("")) for c in ("tenant_id", "project_id", "source_id")))
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(F.when(F.btrim(scope, F.lit(":")) != "", scope), some(F.col("event_id")), F.col("event_name"))


def messages(envelopes: DataFrame) -> DataFrame:
    """Envelopes to (key, value)."""
    # Not by a format: that would go through the session's zone, which may lack the hour.
    time = lambda c: F.concat(F.replace(c.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    bags = {"properties", "user_properties"}
    fields = [(F.try_parse_json(F.coalesce(F.col(c), F.lit("{}"))) if c in bags else time(F.col(c)) if c.endswith("_at") or c == "event_time" else F.col(c)).alias(_JSON[c]) for c in EVENT_COLUMNS]
    return envelopes.select(event_key().alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def read_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of messages from JSON lines ``{"key", "value"}``."""
    reader = spark.readStream.schema("key string, value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def publish_files(envelopes: DataFrame, path: str) -> None:
    messages(envelopes).write.mode("append").json(path)


@dataclass(frozen=True)
class KafkaOptions:
    """Options of the Kafka source and sinks; checked when made."""

    brokers: tuple[str, ...]
    topic: str = "analytics.events"
    dead_letter_topic: str = "analytics.events.dead"
    client_id: str = "quernel"
    max_attempts: int = 5
    retry_backoff_ms: int = 250
    offsets_per_trigger: int = 10_000
    acks: str = "all"
    retries: int = 5
    producer_backoff_ms: int = 100
    batch_bytes: int = 0
    linger_ms: int = 0
    idempotent: bool = False
    tls: bool = False
    sasl: bool = False
    sasl_mechanism: str = ""
    sasl_username: str = ""
    sasl_password: str = field(default="", repr=False)

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("brokers", tuple(b.strip() for b in self.brokers if b.strip()))
        if not self.brokers:
            raise ValueError("kafka brokers are required")
        for name, default in (("topic", "analytics.events"), ("dead_letter_topic", "analytics.events.dead"), ("client_id", "quernel")):
            put(name, getattr(self, name).strip() or default)
        if self.max_attempts <= 0:
            put("max_attempts", 5)
        if self.retry_backoff_ms <= 0:
            put("retry_backoff_ms", 250)
        if self.acks not in ("all", "leader", "none"):
            raise ValueError("kafka producer acks must be one of all, leader, or none")
        for name, what in (("retries", "retry max"), ("producer_backoff_ms", "retry backoff"), ("batch_bytes", "flush bytes"), ("linger_ms", "flush frequency")):
            if getattr(self, name) < 0:
                raise ValueError(f"kafka producer {what} must be >= 0")
        if self.idempotent and self.acks != "all":
            raise ValueError("kafka idempotent producer requires producer acks all")
        if self.idempotent and not self.retries:
            raise ValueError("kafka idempotent producer requires producer retry max >= 1")
        put("sasl_username", self.sasl_username.strip())
        if self.sasl:
            mechanism = self.sasl_mechanism.strip().lower()
            if mechanism not in ("", "plain", "plaintext", "sasl_plaintext"):
                raise ValueError("kafka sasl mechanism must be plain in this version")
            if not self.sasl_username:
                raise ValueError("kafka sasl username is required when sasl is enabled")
            if not self.sasl_password:
                raise ValueError("kafka sasl password is required when sasl is enabled")

    def _common(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": ",".join(self.brokers), "kafka.client.id": self.client_id}
        out["kafka.security.protocol"] = ("SASL_" if self.sasl else "") + ("SSL" if self.tls else "PLAINTEXT")
        if self.sasl:
            quote = lambda x: x.replace("\\", "\\\\").replace('"', '\\"')
            out |= {
                "kafka.sasl.mechanism": "PLAIN",
                "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{quote(self.sasl_username)}" password="{quote(self.sasl_password)}";',
            }
        return out

    def reading(self) -> dict[str, str]:
        """Source options: from the earliest offset, a bounded micro-batch as back-pressure."""
        return self._common() | {"subscribe": self.topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(self.offsets_per_trigger)}

    def writing(self, dead: bool = False) -> dict[str, str]:
        out = self._common() | {
            "topic": self.dead_letter_topic if dead else self.topic, "kafka.acks": {"all": "all", "leader": "1", "none": "0"}[self.acks],
            "kafka.retries": str(self.retries), "kafka.retry.backoff.ms": str(self.producer_backoff_ms),
            "kafka.enable.idempotence": str(self.idempotent).lower(),
        }
        if self.idempotent:
            out["kafka.max.in.flight.requests.per.connection"] = "1"
        if self.batch_bytes:
            out["kafka.batch.size"] = str(self.batch_bytes)
        if self.linger_ms:
            out["kafka.linger.ms"] = str(self.linger_ms)
        return out


def read_kafka(spark: SparkSession, options: KafkaOptions) -> DataFrame:
    """A stream of messages; needs Spark's Kafka connector on the class path."""
    df = spark.readStream.format("kafka").options(**options.reading()).load()
    return df.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset")


def publish_kafka(envelopes: DataFrame, options: KafkaOptions) -> None:
    messages(envelopes).write.format("kafka").options(**options.writing()).save()


def dead_letter_messages(rows: DataFrame) -> DataFrame:
    """Dead letters to (key, value): a JSON record with the envelope as an object and raw bytes in base 64, under the message's own key."""
    time = F.concat(F.replace(F.col("failed_at").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    made = {"envelope": F.try_parse_json("envelope"), "raw": F.base64(F.encode("raw", "UTF-8")), "failed_at": time}
    return rows.select(F.col("original_key").alias("key"), F.to_json(F.struct(*(made.get(c, F.col(c)).alias(c) for c in DEAD_LETTERS.fieldNames()))).alias("value"))


def publish_dead_letters(rows: DataFrame, options: KafkaOptions) -> None:
    """A sink for ``Ingest``: writes dead letters to their topic."""
    dead_letter_messages(rows).write.format("kafka").options(**options.writing(dead=True)).save()


def publish_dead_files(rows: DataFrame, path: str) -> None:
    """The same as JSON lines of files."""
    dead_letter_messages(rows).write.mode("append").json(path)
