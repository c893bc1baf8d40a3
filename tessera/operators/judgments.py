"""Judgments of candidates: the deterministic local one, and shadow runs that ask a provider within bounds and fall back to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Why a judgment is the local one.
FALLBACKS = ["NO_API_KEY", "DISABLED", "RIGHTS_DENIED", "TRUST_DENIED", "BUDGET_EXHAUSTED", "TIMEOUT", "RATE_LIMITED", "CONNECTION_ERROR", "PROVIDER_ERROR", "MALFORMED_RESPONSE"]
#: Reasons after which a call is tried again.
TRANSIENT = ["TIMEOUT", "RATE_LIMITED", "CONNECTION_ERROR"]


class ProviderFailure(Exception):
    """A provider's call that failed, with one of FALLBACKS as its reason."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason if reason in FALLBACKS else "PROVIDER_ERROR"


def keyword_matches(prompt: Column, path: Column, title: Column) -> Column:
    """Each occurrence of a keyword (over two letters) of the prompt: 2 if the path holds it, 3 if the title does."""
    words = F.filter(F.split(F.lower(prompt), r"\W+"), lambda k: F.length(k) > 2)
    low = [F.lower(F.coalesce(x, F.lit(""))) for x in (path, title)]
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(F.contains(low[0], w), 2).otherwise(0) + F.when(F.contains(low[1], w), 3).otherwise(0))


def local_judgment(rows: DataFrame) -> DataFrame:
    """rows with matches, relevance, implementation, edit_target and root_cause.

    rows: prompt, path, title, distance (hops in the graph, null if none), in_evidence, is_direct_dependency.
    """
    rows = rows.withColumn("matches", keyword_matches(F.col("prompt"), F.col("path"), F.col("title")))
    hop1 = F.coalesce(F.col("distance") == 1, F.lit(False))
    near = F.when(hop1, 0.3).when(F.col("distance") == 2, 0.15).otherwise(0.0)
    relevance = F.round(F.least(F.lit(1.0), 0.2 * F.col("matches") + near + F.when(F.col("in_evidence"), 0.4).otherwise(0.0)), 4)
    m, seen = F.col("matches"), F.col("in_evidence")
    return rows.withColumns({"relevance": relevance, "edit_target": seen | (m >= 4) | ((m >= 2) & hop1), "root_cause": seen | ((m >= 3) & F.coalesce("is_direct_dependency", F.lit(False)))}).withColumn("implementation", F.col("relevance") >= 0.25)


#: What a judgment says, whoever gives it.
SAID = ["relevance", "implementation", "edit_target", "root_cause"]


def shadow_run(judged: DataFrame, provider: Callable[[dict], dict] | None, calls: int, attempts: int = 2, concurrency: int = 4) -> DataFrame:
    """task_id, unit_id, status (OK or FALLBACK), reason, tries and the judgment: the provider's for each task's first `calls` candidates, else the local one.

    judged: what local_judgment gives, with rank, rights and trusted. A task's calls run at most `concurrency` at a time; transient failures
    are tried again up to `attempts` times. Rows are handled where they are: a batch at a time, nothing is grouped. Rows that
    are not asked for are no work in Python, and their texts don't go there.
    """
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("rank", "unit_id"))
    gate = F.when(~F.col("rights"), "RIGHTS_DENIED").when(~F.col("trusted"), "TRUST_DENIED").when(place > calls, "BUDGET_EXHAUSTED")
    if provider is None:
        gate = F.lit("NO_API_KEY")
    columns = ["task_id", "unit_id", "path", "title", "prompt", *SAID]
    asked = lambda k: F.when(F.col("refused").isNull(), F.col(k)).alias(k)
    rows = judged.withColumn("refused", gate).select("task_id", "unit_id", *map(asked, columns[2:5]), *SAID, "refused")

    def ask(row: dict) -> tuple:
        reason, tries = None, 0
        while reason is None and tries < attempts:
            tries += 1
            try:
                said = provider({k: row[k] for k in columns[:5]})
                return ("OK", "NONE", tries, *(float(said["relevance"]), *(bool(said[k]) for k in SAID[1:])))
            except ProviderFailure as failure:
                reason = failure.reason if failure.reason not in TRANSIENT or tries == attempts else None
            except (KeyError, TypeError, ValueError):
                reason = "MALFORMED_RESPONSE"
        return ("FALLBACK", reason, tries, *(row[k] for k in SAID))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                calls = frame["refused"].isna()
                local = frame[~calls]
                yield pd.concat([local[["task_id", "unit_id"]].assign(status="FALLBACK", reason=local["refused"], tries=0), local[SAID]], axis=1)
                frame = frame[calls]
                held = frame.astype(object).where(frame.notna(), None).to_dict("records")
                step = max(1, min(64, -(-len(held) // concurrency)))  # a thread takes some rows at a time
                parts = pool.map(lambda part: [ask(row) for row in part], [held[i : i + step] for i in range(0, len(held), step)])
                got = pd.DataFrame([x for part in parts for x in part], columns=["status", "reason", "tries", *SAID])
                yield pd.concat([frame[["task_id", "unit_id"]].reset_index(drop=True), got], axis=1)

    return rows.mapInPandas(run, "task_id long, unit_id long, status string, reason string, tries int, relevance double, implementation boolean, edit_target boolean, root_cause boolean")


#: What the statistics call the reasons of calls that failed.
FAILED = {"TIMEOUT": "timeouts", "RATE_LIMITED": "rate_limited", "MALFORMED_RESPONSE": "malformed", "CONNECTION_ERROR": "connection_errors", "PROVIDER_ERROR": "provider_errors"}


def call_statistics(calls: DataFrame, order: list[str], most_calls: int = 20) -> DataFrame:
    """For each task: eligible, attempted, successful, failed, fallback, rights_denied, trust_denied, budget_skipped, and failures by reason.

    calls: task_id, the columns of order, and outcome (OK, or one of FALLBACKS). Denied ones are never attempted; of the others the first
    most_calls are, and the rest is skipped, whatever would have come of it.
    """
    denied = F.col("outcome").isin("RIGHTS_DENIED", "TRUST_DENIED")
    before = Window.partitionBy("task_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = calls.withColumn("place", F.count(F.when(~denied, True)).over(before))
    said = F.when(denied | (F.col("place") <= most_calls), F.col("outcome")).otherwise("BUDGET_EXHAUSTED")
    rows = rows.select("task_id", said.alias("said"))
    count = lambda *names: F.count_if(F.col("said").isin(*names))
    return rows.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("eligible"), count("OK", *FAILED).alias("attempted"), count("OK").alias("successful"), count(*FAILED).alias("failed"), F.count_if(F.col("said") != "OK").alias("fallback"),
        count("RIGHTS_DENIED").alias("rights_denied"), count("TRUST_DENIED").alias("trust_denied"), count("BUDGET_EXHAUSTED").alias("budget_skipped"), *[count(k).alias(v) for k, v in FAILED.items()],
    )
