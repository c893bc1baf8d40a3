"""Resolutions, token costs, and packing under a budget."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Resolutions, coarse to full, with the share of a unit's raw tokens and of its utility that each has.
OMIT, NAME, SIGNATURE, SKELETON, BODY, FULL = range(6)
SHARE = {SIGNATURE: 0.10, SKELETON: 0.25, BODY: 0.75}
UTILITY = {NAME: 0.15, SIGNATURE: 0.40, SKELETON: 0.70, BODY: 0.95, FULL: 1.0}
CODE = ["SOURCE_FILE", "TEST", "CODE_SYMBOL"]
WHOLE_ONLY = ["CONFIG", "SCHEMA", "MIGRATION", "LOCKFILE", "DOCUMENTATION"]


def c(name: str) -> Column:
    return F.col(name)


def resolution_tokens(raw: Column, resolution: Column) -> Column:
    out = F.when(resolution == FULL, raw)
    for r, share in SHARE.items():
        out = out.when(resolution == r, F.greatest(F.lit(5), F.ceil(raw * share)))
    return out.when(resolution == NAME, 5).when(resolution == OMIT, 0).otherwise(raw).cast("long")


def is_edit_target() -> Column:
    return c("in_stack_trace") | c("is_failing_test_target") | c("in_compiler_error") | c("in_dirty_diff")


def supports(kind: Column, unsafe: Column, resolution: int) -> Column:
    if resolution == SKELETON:
        return kind.isin(CODE) & ~unsafe
    return kind.isin(CODE) if resolution == SIGNATURE else F.lit(True)


def nearest_safe(kind: Column, unsafe: Column, resolution: Column) -> Column:
    """The resolution itself if the unit supports it, else the next safe one below."""
    out = resolution
    out = F.when((resolution == SKELETON) & ~supports(kind, unsafe, SKELETON), F.when(supports(kind, unsafe, SIGNATURE), SIGNATURE).otherwise(NAME)).otherwise(out)
    return F.when((resolution == SIGNATURE) & ~supports(kind, unsafe, SIGNATURE), NAME).otherwise(out)


def allocated(priority: Column, pressure: Column) -> Column:
    """The first resolution of a unit under pressure (raw tokens by budget). Columns: kind, tokens, unsafe, distance, is_direct and the evidence flags."""
    return (
        F.when(priority | is_edit_target(), F.when((pressure > 1.8) & (c("tokens") > 500), BODY).otherwise(FULL))
        .when(c("kind").isin(WHOLE_ONLY), F.when(pressure > 1.3, NAME).otherwise(FULL))
        .when(c("distance") >= 2, F.when((pressure > 1.2) | c("unsafe"), SIGNATURE).otherwise(SKELETON))
        .when((c("distance") == 1) | c("is_direct"), F.when(pressure > 1.5, F.when(c("unsafe"), SIGNATURE).otherwise(SKELETON)).otherwise(BODY))
        .when((pressure > 1.0) | c("unsafe"), SIGNATURE)
        .otherwise(SKELETON)
    )


def least_useful() -> Column:
    return F.when(is_edit_target(), BODY).when(c("is_direct") | F.coalesce(c("distance") == 1, F.lit(False)), SIGNATURE).otherwise(NAME)


def resolution_curve(units: DataFrame, utility: Column) -> DataFrame:
    """A row for each unit and resolution: allowed, token_cost (0 if not), utility."""
    options = F.explode(F.array(*[F.struct(F.lit(r).alias("resolution"), F.lit(u).alias("share"), supports(c("kind"), c("unsafe"), r).alias("allowed")) for r, u in UTILITY.items()])).alias("o")
    rows = units.select("unit_id", "tokens", utility.alias("u"), options)
    cost = F.when(c("o.allowed"), resolution_tokens(c("tokens"), c("o.resolution"))).otherwise(0)
    return rows.select("unit_id", c("o.resolution").alias("resolution"), c("o.allowed").alias("allowed"), cost.cast("long").alias("token_cost"), F.round(c("u") * c("o.share"), 4).alias("utility"))


#: Token limits of the named profiles.
PROFILES = {"MINIMAL": 4000, "BALANCED": 16_000, "THOROUGH": 32_000, "MAXIMAL": 64_000}


def affordable(max_cost: float | None, model: str) -> int | None:
    """The most tokens whose price, rounded to 6 places, is within a ceiling in dollars; None without one."""
    if not max_cost:
        return None
    micros = Decimal(str(max_cost)).scaleb(6) + Decimal("0.5")
    return max(0, int((micros / Decimal(str(price_of(model)))).to_integral_value(ROUND_CEILING)) - 1)


def solve_budget(selected: DataFrame, limit: int, max_cost: float | None = None, model: str = "claude-3-7-sonnet") -> DataFrame:
    """selected (task_id, unit_id, place, heuristic_score, tokens, kind, unsafe, distance, is_direct, evidence flags) with resolution and token_cost
    under a token limit and, if given, a ceiling of cost in dollars.

    First an allocation by pressure; while a task is over its limit, units that are no edit targets go down level by level, lowest
    heuristic score first, until it fits. Within a level the units that go down are a prefix of that order: the first place at which
    what is freed suffices. Five chained windows, no fold.
    """
    task = Window.partitionBy("task_id")
    most = affordable(max_cost, model)
    most = limit if most is None else min(limit, most)
    rows = selected.withColumn("raw_total", F.sum("tokens").over(task))
    rows = rows.withColumn("resolution", allocated(c("place") == 1, c("raw_total") / F.lit(limit)))
    rows = rows.withColumn("cost", resolution_tokens(c("tokens"), c("resolution")))
    never = c("unsafe") | c("kind").isin(WHOLE_ONLY)
    for level in (BODY, SKELETON, SIGNATURE, NAME, OMIT):
        moves = ~is_edit_target() & (c("resolution") > level) & (~never if level == SKELETON else F.lit(True))
        order = task.orderBy("heuristic_score", "place").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("freed", F.when(moves, c("cost") - resolution_tokens(c("tokens"), F.lit(level))).otherwise(0))
        # What is over the limit before each unit's turn: degradation stops at the first turn that finds the task within it.
        rows = rows.withColumn("over", F.sum("cost").over(task) - F.coalesce(F.sum("freed").over(order), F.lit(0)) - most)
        rows = rows.withColumn("stopped", F.max((c("over") <= 0).cast("int")).over(task.orderBy("heuristic_score", "place")) == 1)
        down = moves & ~c("stopped")
        rows = rows.withColumn("cost", F.when(down, c("cost") - c("freed")).otherwise(c("cost"))).withColumn("resolution", F.when(down, level).otherwise(c("resolution")))
    fixed = (c("resolution") == SKELETON) & never
    rows = rows.withColumn("cost", F.when(fixed, resolution_tokens(c("tokens"), F.lit(SIGNATURE))).otherwise(c("cost"))).withColumn("resolution", F.when(fixed, SIGNATURE).otherwise(c("resolution")))
    return rows.select("task_id", "unit_id", "resolution", c("cost").alias("token_cost"))


def plan_totals(selected: DataFrame, solved: DataFrame, model: str = "claude-3-7-sonnet") -> DataFrame:
    """For each task: tokens and cost of the plan (solved) and of its units as they are (selected: tokens), and what is saved."""
    raw = selected.groupBy("task_id").agg(F.sum("tokens").alias("raw_tokens"))
    rows = solved.groupBy("task_id").agg(F.sum("token_cost").alias("total_tokens")).join(raw, "task_id")
    saved = F.greatest(F.lit(0).cast("long"), c("raw_tokens") - c("total_tokens"))
    cost, base = (model_cost(c(x), F.lit(model)) for x in ("total_tokens", "raw_tokens"))
    rows = rows.select("task_id", "total_tokens", "raw_tokens", saved.alias("tokens_saved"), F.when(c("raw_tokens") > 0, F.round(saved / c("raw_tokens") * 100, 1)).otherwise(0.0).alias("savings_percentage"), cost.alias("cost"), base.alias("baseline_cost"))
    return rows.withColumn("cost_saved", F.round(F.greatest(F.lit(0.0), c("baseline_cost") - c("cost")), 6))


#: Prices of a million prompt tokens, by a part of the model's name; the longest part that fits counts.
PRICES = {"claude-3-7-sonnet": 3.0, "claude-3-5-sonnet": 3.0, "claude-3-opus": 15.0, "gpt-4o": 2.5, "gpt-4o-mini": 0.15, "o1": 15.0, "gemini-1.5-pro": 3.5}
DEFAULT_PRICE = 3.0


def price_of(model: str) -> float:
    fits = [p for p in PRICES if p in model.lower()]
    return PRICES[max(fits, key=len)] if fits else DEFAULT_PRICE


def model_cost(tokens: Column, model: Column) -> Column:
    price = F.lit(DEFAULT_PRICE)
    for part in sorted(PRICES, key=len):
        price = F.when(F.lower(model).contains(part), PRICES[part]).otherwise(price)
    return F.round(tokens / 1_000_000 * price, 6)


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """For each element of a column of arrays, the place of its row in the batch; and the elements. A null array has none."""
    held = batch.column(column)
    return np.repeat(np.arange(len(held)), np.asarray(held.value_lengths().fill_null(0), dtype=np.int64)), held.flatten()


def _least(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, starts)


def compose_bundles(ranked: DataFrame, links: DataFrame, evidence: DataFrame, max_units: int = 25, max_tokens: int = 16_000) -> DataFrame:
    """Greedy bundles: task_id, unit_id, place, gain. ranked: task_id, unit_id, rank, score, tokens, path and, if units are taken by their
    resolution curves, bonus (five times the utility of the resolution whose tokens these are); links: task_id, src, dst; evidence: task_id, path.

    Each choice changes the next ones' gains, so a task is a fold; its candidates are few (a top-n). All tasks of a batch take their next choice at once.
    """
    bonus = F.col("bonus") if "bonus" in ranked.columns else F.lit(0.0)
    a = ranked.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "unit_id", "score", "tokens", "path", bonus.alias("bonus")))).alias("rows"))
    b = links.groupBy("task_id").agg(F.collect_set(F.struct("src", "dst")).alias("links"))
    e = evidence.groupBy("task_id").agg(F.collect_set("path").alias("evidence"))
    whole = a.join(b, "task_id", "left").join(e, "task_id", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            task, rows = _flat(batch, "rows")
            unit, score, tokens, extra = (np.asarray(rows.field(k)) for k in ("unit_id", "score", "tokens", "bonus"))
            paths = rows.field("path").fill_null("").dictionary_encode()
            names, code = paths.dictionary.to_pylist(), np.asarray(paths.indices)
            starts = np.searchsorted(task, np.arange(batch.num_rows))
            # A file is a path of a task, a node a unit of a task.
            files, file = np.unique(task * len(names) + code, return_inverse=True)
            named = np.array([bool(x) for x in names])[files % len(names)]
            owner, shown = _flat(batch, "evidence")
            shown = shown.dictionary_encode()
            stated, said = shown.dictionary.to_pylist(), np.asarray(shown.indices)
            first = np.searchsorted(files // len(names), np.arange(batch.num_rows + 1))
            n = np.diff(first)[owner]
            entry = np.repeat(np.arange(len(owner)), n)
            where = np.repeat(first[owner] - (np.cumsum(n) - n), n) + np.arange(len(entry))
            asked, back = np.unique((files[where] % len(names)) * max(1, len(stated)) + said[entry], return_inverse=True)
            meet = np.array([bool(r) and (p in r or r in p) for r, p in ((names[k // len(stated)], stated[k % len(stated)]) for k in asked.tolist())], dtype=bool)[back]
            entry, where = entry[meet], where[meet]
            units, node_unit = np.unique(unit, return_inverse=True)
            nodes, node = np.unique(task * len(units) + node_unit, return_inverse=True)
            owns, pair = _flat(batch, "links")
            ends = []
            for end in ("src", "dst"):
                value = np.asarray(pair.field(end), dtype=np.int64)
                at = np.minimum(np.searchsorted(units, value), len(units) - 1)
                key = owns * len(units) + at
                place = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
                ends.append((place, (units[at] == value) & (nodes[place] == key)))
            both = ends[0][1] & ends[1][1]
            src, dst = ends[0][0][both], ends[1][0][both]
            left, near, taken, open_ = np.ones(len(unit), bool), np.zeros(len(nodes), bool), np.zeros(len(files), np.int64), np.ones(len(owner), bool)
            used, every, done, out = np.zeros(batch.num_rows, np.int64), np.arange(len(unit)), np.zeros(batch.num_rows, bool), []
            for turn in range(1, max_units + 1):
                covers = np.bincount(where, weights=open_[entry], minlength=len(files)) > 0
                gain = score / 10 + 1.5 * near[node] + 30 * covers[file]
                gain = gain + (extra - 5 * np.maximum(0, taken[file] - 2) * named[file])
                gain = np.where(left & (used[task] + tokens <= max_tokens) & (used < max_tokens)[task] & ~done[task], gain, 0.0)
                best = np.maximum.reduceat(gain, starts)
                done |= ~(best > 0)
                if done.all():
                    break
                chosen = _least(np.where(gain == best[task], every, len(unit)), starts)[~done]
                left[chosen] = False
                used[task[chosen]] += tokens[chosen]
                taken[file[chosen]] += 1
                picked = np.zeros(len(nodes), bool)
                picked[node[chosen]] = True
                near[dst[picked[src]]] = True
                closed = np.zeros(len(files), bool)
                closed[file[chosen]] = True
                open_[entry[closed[where]]] = False
                out.append((task[chosen], unit[chosen], np.full(len(chosen), turn, np.int32), [round(x, 2) for x in gain[chosen].tolist()]))
            for held, ids, places, gains in out:
                yield pa.RecordBatch.from_arrays([batch.column("task_id").take(pa.array(held)), pa.array(ids), pa.array(places), pa.array(gains)], ["task_id", "unit_id", "place", "gain"])

    return whole.mapInArrow(pack, "task_id long, unit_id long, place int, gain double")


def fit_rendered(plan: DataFrame, limit: int) -> DataFrame:
    """task_id, unit_id, resolution after the last gate: while rendered tokens exceed the limit one unit goes down, the least needed first.

    plan: task_id, unit_id, place, tokens, resolution, least, mandatory, safe. Each step depends on the one before; a task's plan is small. All tasks
    of a batch that are over the limit take their next step at once.
    """
    whole = plan.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("place", "unit_id", "tokens", "resolution", "least", "mandatory", "safe"))).alias("rows"))
    shares = np.array([0.0, 0.0, 0.1, 0.25, 0.75, 1.0])

    def cost(tokens: np.ndarray, resolution: np.ndarray) -> np.ndarray:
        return np.where(resolution == FULL, tokens, np.maximum(5, np.ceil(tokens * shares[resolution]).astype(np.int64)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            task, rows = _flat(batch, "rows")
            unit, tokens, resolution, least = (np.array(rows.field(k)) for k in ("unit_id", "tokens", "resolution", "least"))
            mandatory, safe = (np.asarray(rows.field(k).to_numpy(zero_copy_only=False)) for k in ("mandatory", "safe"))
            left, stuck = np.ones(len(unit), bool), np.zeros(batch.num_rows, bool)
            while True:
                total = np.bincount(task, weights=np.where(left, cost(tokens, resolution), 0), minlength=batch.num_rows)
                at = np.flatnonzero(left & ((total > limit) & ~stuck)[task])
                if not len(at):
                    break
                own, starts = np.unique(task[at], return_index=True)
                r, optional = resolution[at], ~mandatory[at]
                place = np.arange(len(at))
                first = lambda test: _least(np.where(test, place, len(at)), starts)
                last = lambda test: np.maximum.reduceat(np.where(test, place, -1), starts)
                full = first((r == FULL) & optional)
                full = np.where(full < len(at), full, last(r == FULL))
                full = np.where((full >= 0) & (least[at][full] <= BODY), full, -1)
                body = first((r == BODY) & optional & (least[at] <= SKELETON) & safe[at])
                steps = [full, np.where(body < len(at), body, -1), last((r == SKELETON) & optional & (least[at] <= SIGNATURE)), last((r == SIGNATURE) & optional & (least[at] <= NAME))]
                down = np.full(len(own), -1)
                for step in steps:
                    down = np.where(down < 0, step, down)
                resolution[at[down[down >= 0]]] -= 1
                out = np.where(down < 0, last(optional), -1)
                left[at[out[out >= 0]]] = False
                stuck[own[(down < 0) & (out < 0)]] = True
            over = total > limit
            yield pa.RecordBatch.from_arrays([batch.column("task_id").take(pa.array(task[left])), pa.array(unit[left]), pa.array(resolution[left].astype(np.int32)), pa.array(over[task[left]])], ["task_id", "unit_id", "resolution", "overflow"])

    return whole.mapInArrow(fit, "task_id long, unit_id long, resolution int, overflow boolean")
