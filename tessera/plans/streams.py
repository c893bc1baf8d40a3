"""Batch forms of the event-log queries; streaming/events.py has the streaming forms, tests hold both together."""

import uuid

from pyspark.sql import functions as F

from tessera.operators.judgments import call_statistics
from tessera.registry import query
from tessera.sources.sinks import KeyedTable
from tessera.sources.tables import table
from tessera.storage import new_folder, shared_folder
from tessera.streaming.events import counters, latest_events, newest_sessions, retained, upsert_batches
from tessera.streaming.state import expired_items, newest_items, newest_of, run_to_end, slot_table


def c(name):
    return F.col(name)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def t01_retained_events(spark, folder):
    return retained(table(spark, folder, "events"), table(spark, folder, "customer").filter("c_acctbal > 0").select(c("c_custkey").alias("user_id"))).select("event_id", "user_id")


@query("SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def t02_daily_counters(spark, folder):
    return counters(table(spark, folder, "events")).select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 150")
def t03_latest_150(spark, folder):
    return latest_events(table(spark, folder, "events"), 150).select("event_id", "user_id")


@query("""WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), e AS (SELECT user_id, min(n) AS n FROM s WHERE event_type IN ('purchase', 'error') GROUP BY ALL)
  SELECT a.user_id, CASE WHEN s.event_type = 'purchase' THEN 'COMPLETED' WHEN s.event_type = 'error' THEN 'ABORTED' WHEN a.k = 1 THEN 'STARTED' ELSE 'ACTIVE' END AS state
  FROM (SELECT user_id, count(*) AS k FROM events GROUP BY ALL) a LEFT JOIN e USING (user_id) LEFT JOIN s ON s.user_id = e.user_id AND s.n = e.n""")
def t04_session_states(spark, folder):
    order = F.struct("ts", "event_id")
    ends = F.when(c("event_type") == "purchase", "COMPLETED").when(c("event_type") == "error", "ABORTED")
    g = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), F.min_by(ends, F.when(ends.isNotNull(), order)).alias("end"))
    return g.select("user_id", F.coalesce("end", F.when(c("k") == 1, "STARTED").otherwise("ACTIVE")).alias("state"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS")
def t06_retention(spark, folder):
    return table(spark, folder, "events").filter(c("ts") >= F.lit("2024-01-31").cast("timestamp") - F.expr("INTERVAL 10 DAYS")).select("event_id")


@query("SELECT event_id, user_id, event_type FROM events")
def t08_replayed_upsert(spark, folder):
    """A log that is delivered twice, by two streams with checkpoints of their own, into a table with the event as key: each event once."""
    where = f"{shared_folder(spark)}/tessera/replay-{uuid.uuid4().hex}"
    schema = "event_id long, user_id long, event_type string"
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    events.repartition(3, "event_id").write.parquet(f"{where}/log")
    keyed = KeyedTable(spark, f"{where}/table", ["event_id"], schema)
    for delivery in ("first", "second"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/log")
        upsert_batches(stream, keyed, f"{where}/{delivery}", [c("user_id").desc()]).start().awaitTermination()
    return keyed.rows()


@query("SELECT user_id * 1000 + dayofyear(ts) AS session, min(ts)::VARCHAR AS first FROM events GROUP BY ALL ORDER BY min(ts) DESC, session DESC LIMIT 10000")
def t02_newest_sessions(spark, folder):
    """Unique sessions (a user's day), the oldest forgotten beyond 10,000."""
    events = table(spark, folder, "events").select((c("user_id") * 1000 + F.dayofyear("ts")).alias("session"), "ts")
    return newest_sessions(events).select("session", c("first").cast("string").alias("first"))


#: Events as calls of a provider: what came of them.
_OUTCOMES = {"view": "OK", "click": "OK", "purchase": "TRUST_DENIED", "error": "TIMEOUT", "signup": "MALFORMED_RESPONSE"}
_SAID = "CASE WHEN event_id % 31 = 0 THEN 'RIGHTS_DENIED' " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in _OUTCOMES.items()) + " ELSE 'PROVIDER_ERROR' END"


@query(f"""WITH o AS (SELECT user_id, event_id, {_SAID} AS outcome FROM events), p AS (SELECT *, count(*) FILTER (WHERE NOT ends_with(outcome, '_DENIED')) OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM o),
  s AS (SELECT user_id, CASE WHEN ends_with(outcome, '_DENIED') OR place <= 20 THEN outcome ELSE 'BUDGET_EXHAUSTED' END AS said FROM p)
  SELECT user_id AS task_id, count(*) AS eligible, count(*) FILTER (WHERE said IN ('OK', 'TIMEOUT', 'MALFORMED_RESPONSE', 'PROVIDER_ERROR')) AS attempted, count(*) FILTER (WHERE said = 'OK') AS successful, count(*) FILTER (WHERE said IN ('TIMEOUT', 'MALFORMED_RESPONSE', 'PROVIDER_ERROR')) AS failed,
  count(*) FILTER (WHERE said <> 'OK') AS fallback, count(*) FILTER (WHERE said = 'RIGHTS_DENIED') AS rights_denied, count(*) FILTER (WHERE said = 'TRUST_DENIED') AS trust_denied, count(*) FILTER (WHERE said = 'BUDGET_EXHAUSTED') AS budget_skipped, count(*) FILTER (WHERE said = 'TIMEOUT') AS timeouts,
  0::BIGINT AS rate_limited, count(*) FILTER (WHERE said = 'MALFORMED_RESPONSE') AS malformed, 0::BIGINT AS connection_errors, count(*) FILTER (WHERE said = 'PROVIDER_ERROR') AS provider_errors FROM s GROUP BY user_id""")
def t07_call_budget(spark, folder):
    """What came of each task's calls under a budget of twenty: attempted, denied, skipped, and failed by reason."""
    calls = table(spark, folder, "events").select(c("user_id").alias("task_id"), "event_id", F.expr(_SAID).alias("outcome"))
    return call_statistics(calls, ["event_id"])


def _in_two_runs(spark, folder, columns, changes, apply):
    """Events arrive in a log in two deliveries; the stream of changes ends after the first, and goes on from its checkpoint."""
    events, where = table(spark, folder, "events"), new_folder(spark, "stream")
    rows = events.select(c("ts").cast("timestamp").alias("ts"), *columns)
    middle = F.timestamp_micros(((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2).cast("long"))
    half = events.agg(middle.alias("half")).first()["half"]
    for delivery in (c("ts") < F.lit(half), c("ts") >= F.lit(half)):
        rows.filter(delivery).write.mode("append").parquet(f"{where}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/log")
        run_to_end(changes(stream), f"{where}/checkpoint", lambda batch, n: apply(batch, (where, n)))


def _newest(spark, folder, item, cap):
    slots = slot_table(spark, new_folder(spark, "slots"))
    _in_two_runs(spark, folder, [item.alias("item"), F.unix_micros(c("ts").cast("timestamp")).alias("at")], lambda s: newest_items(s.select("item", "at"), cap), lambda batch, n: slots.upsert(batch, [c("at").desc()], n))
    return newest_of(slots, cap)


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 150")
def t03_ring_stream(spark, folder):
    """The last 150 events as the state of a stream that is started twice."""
    held = _newest(spark, folder, c("event_id"), 150).select(c("item").alias("event_id"))
    return table(spark, folder, "events").join(held, "event_id", "left_semi").select("event_id", "user_id")


@query("SELECT user_id * 1000 + dayofyear(ts) AS session, epoch_us(min(ts)) AS first_us FROM events GROUP BY ALL ORDER BY min(ts) DESC, session DESC LIMIT 10000")
def t02_session_stream(spark, folder):
    """Unique sessions as the state of a stream that is started twice: the oldest goes when one more than 10,000 comes."""
    return _newest(spark, folder, c("user_id") * 1000 + F.dayofyear("ts"), 10_000).select(c("item").alias("session"), c("at").alias("first_us"))


@query("SELECT event_id FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR + INTERVAL 10 DAYS > (SELECT max(ts) FROM events) - INTERVAL 2 DAYS")
def t06_retention_stream(spark, folder):
    """A keyed table from which a stream's timers take what is older than ten days at its watermark."""
    kept = KeyedTable(spark, new_folder(spark, "retained"), ["event_id"], "event_id long, user_id long")
    kept.upsert(table(spark, folder, "events"), [c("user_id").desc()])
    _in_two_runs(spark, folder, [c("event_id").alias("item")], lambda s: expired_items(s, 10), lambda batch, n: kept.delete(batch.select(c("item").alias("event_id"))))
    return kept.rows().select("event_id")
