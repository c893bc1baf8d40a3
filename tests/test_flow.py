"""The folds of packing against plain Python, on the rows that the flow gives and on random ones."""

import math
import os

import numpy as np
import pytest

from tessera.operators.flow import pack, rank_features
from tessera.operators.packing import affordable, compose_bundles, fit_rendered, plan_totals, solve_budget
from tessera.plans.flow import flow_rows
from tessera.sources.tables import evidence, unit_edges
from tessera.storage import settled

FOLDER = "/root/testdata/sf0.001"
CODE, WHOLE = ("SOURCE_FILE", "TEST", "CODE_SYMBOL"), ("CONFIG", "SCHEMA", "MIGRATION", "LOCKFILE", "DOCUMENTATION")
SHARE = {1: 0.15, 2: 0.4, 3: 0.7, 4: 0.95, 5: 1.0}


def cost(raw, r):
    return {0: 0, 1: 5, 5: raw}[r] if r in (0, 1, 5) else max(5, math.ceil(raw * {2: 0.1, 3: 0.25, 4: 0.75}[r]))


def edit(u):
    return u["in_stack_trace"] or u["is_failing_test_target"] or u["in_compiler_error"] or u["in_dirty_diff"]


def least(u):
    return 4 if edit(u) else 2 if u["is_direct"] or u["distance"] == 1 else 1


def allowed(u, r):
    return (u["kind"] in CODE and not u["unsafe"]) if r == 3 else u["kind"] in CODE if r == 2 else True


def compose(rows, links, paths, limit, most):
    """rows in order of rank, with tokens and bonus; the bundle's (unit, gain) in order."""
    left, near, files, used, out, uncovered = list(rows), set(), {}, 0, [], set(paths)
    while left and len(out) < most and used < limit:
        gains = []
        for r in left:
            if used + r["tokens"] <= limit:
                gain = r["score"] / 10 + (1.5 if r["unit_id"] in near else 0) + r.get("bonus", 0.0) - 5 * max(0, files.get(r["path"], 0) - 2)
                gains.append((gain + (30 if any(p in r["path"] or r["path"] in p for p in uncovered) else 0), r))
        if not gains or max(g for g, _ in gains) <= 0:
            break
        gain, best = max(gains, key=lambda x: x[0])
        left.remove(best)
        used += best["tokens"]
        near |= {b for a, b in links if a == best["unit_id"]}
        files[best["path"]] = files.get(best["path"], 0) + 1
        uncovered = {p for p in uncovered if p not in best["path"] and best["path"] not in p}
        out.append((best["unit_id"], round(gain, 2)))
    return out


def allocate(u, first, pressure):
    if first or edit(u):
        return 4 if pressure > 1.8 and u["tokens"] > 500 else 5
    if u["kind"] in WHOLE:
        return 1 if pressure > 1.3 else 5
    d = u["distance"]
    if d is not None and d >= 2:
        return 2 if pressure > 1.2 or u["unsafe"] else 3
    if d == 1 or u["is_direct"]:
        return (2 if u["unsafe"] else 3) if pressure > 1.5 else 4
    return 2 if pressure > 1.0 or u["unsafe"] else 3


def solve(units, limit, ceiling=None):
    """units in order of place: resolution of each."""
    pressure = sum(u["tokens"] for u in units) / limit
    got = {u["unit_id"]: allocate(u, i == 0, pressure) for i, u in enumerate(units)}
    total = lambda: sum(cost(u["tokens"], got[u["unit_id"]]) for u in units)
    over = lambda: total() > limit or (ceiling is not None and round(total() * 3 / 1e6, 6) > ceiling)
    for level in (4, 3, 2, 1, 0):
        for u in sorted((u for u in units if not edit(u)), key=lambda u: u["heuristic_score"]):
            if not over():
                break
            if got[u["unit_id"]] > level and not (level == 3 and (u["unsafe"] or u["kind"] in WHOLE)):
                got[u["unit_id"]] = level
    return {k: 2 if r == 3 and any(u["unit_id"] == k and (u["unsafe"] or u["kind"] in WHOLE) for u in units) else r for k, r in got.items()}


def gate(units, limit):
    """units in order of place with resolution, least, mandatory, safe: what stays, and whether it is still too much."""
    units = [dict(u) for u in units]
    while sum(cost(u["tokens"], u["resolution"]) for u in units) > limit:
        def down(found, level):
            for u in found:
                if level >= u["least"] and (level != 3 or u["safe"]):
                    u["resolution"] = level
                    return True
            return False

        at = lambda r: [u for u in units if u["resolution"] == r]
        free = lambda r: [u for u in at(r) if not u["mandatory"]]
        if not (down((free(5) or at(5)[-1:])[:1], 4) or down(free(4), 3) or down(free(3)[::-1], 2) or down(free(2)[::-1], 1)):
            optional = [u for u in units if not u["mandatory"]]
            if not optional:
                return units, True
            units.remove(optional[-1])
    return units, False


@pytest.fixture(scope="module")
def rows(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("tables are not here")
    return settled(rank_features(flow_rows(spark, FOLDER)), "ranked-features")


@pytest.mark.parametrize("limit, ceiling", [(4000, None), (1500, None), (16_000, 0.005)])
def test_flow_against_plain_python(spark, rows, limit, ceiling):
    links, paths = unit_edges(spark, FOLDER), evidence(spark, FOLDER)
    got = {}
    for r in pack(rows, links, paths, limit=limit, max_cost=ceiling).collect():
        got.setdefault(r.task_id, {})[r.unit_id] = (r.place, r.gain, r.solved_resolution, r.resolution, r.overflow)
    edges = {(r.src, r.dst) for r in links.collect()}
    said = {}
    for r in paths.collect():
        said.setdefault(r.task_id, set()).add(r.path)
    tasks = {}
    for r in rows.orderBy("task_id", "rank").collect():
        tasks.setdefault(r.task_id, []).append(r.asDict() | {"distance": r.min_distance_to_seed, "is_direct": r.is_direct_dependency or r.is_direct_dependent})
    assert len(tasks) > 20
    for task, units in tasks.items():
        priced = []
        for u in units:
            options = [(cost(u["tokens"], r), r, u["score"] * s) for r, s in SHARE.items() if allowed(u, r) and r >= least(u)]
            if options:
                price, _, value = min(options)
                priced.append({**u, "tokens": price, "bonus": 5 * round(value + 0.0, 4)})
        chosen = compose(priced, edges, said.get(task, ()), limit, 25)
        by_id = {u["unit_id"]: u for u in units}
        held = [by_id[i] for i, _ in chosen]
        solved = solve(held, limit, ceiling) if held else {}
        left, over = gate([{**u, "resolution": solved[u["unit_id"]], "least": least(u), "mandatory": u["in_stack_trace"] or u["in_dirty_diff"], "safe": not u["unsafe"]} for u in held], limit)
        mine = got.get(task, {})
        assert set(mine) == {u["unit_id"] for u in left}
        for place, (i, gain) in enumerate(chosen, 1):
            if i in mine:
                assert mine[i][0] == place and abs(mine[i][1] - gain) < 0.02
                assert mine[i][2:] == (solved[i], next(u["resolution"] for u in left if u["unit_id"] == i), over)


def test_bundles_and_gate_on_random_rows(spark):
    rng = np.random.default_rng(5)
    tasks = {t: [{"unit_id": int(i), "rank": k + 1, "score": float(rng.integers(0, 60)), "tokens": int(rng.integers(1, 900)), "path": f"d/{rng.integers(0, 4)}.ts"} for k, i in enumerate(rng.permutation(30)[: rng.integers(1, 20)])] for t in range(25)}
    links = {t: {(int(a), int(b)) for a, b in rng.integers(0, 30, (25, 2))} for t in tasks}
    paths = {t: [f"{rng.integers(0, 4)}.ts"] * int(t % 2) for t in tasks}
    ranked = spark.createDataFrame([(t, u["unit_id"], u["rank"], u["score"], u["tokens"], u["path"]) for t, us in tasks.items() for u in us], "task_id long, unit_id long, rank int, score double, tokens long, path string")
    got = compose_bundles(ranked, spark.createDataFrame([(t, a, b) for t, x in links.items() for a, b in x], "task_id long, src long, dst long"), spark.createDataFrame([(t, p) for t, ps in paths.items() for p in ps], "task_id long, path string"), max_units=8, max_tokens=3000).collect()
    for t, us in tasks.items():
        assert [(r.unit_id, r.gain) for r in sorted((r for r in got if r.task_id == t), key=lambda r: r.place)] == compose(us, links[t], paths[t], 3000, 8)
    plans = {t: [{"unit_id": u["unit_id"], "tokens": u["tokens"], "resolution": int(rng.integers(1, 6)), "least": int(rng.integers(1, 5)), "mandatory": bool(rng.random() < 0.3), "safe": bool(rng.random() < 0.7)} for u in us] for t, us in tasks.items()}
    frame = spark.createDataFrame([(t, u["unit_id"], k, u["tokens"], u["resolution"], u["least"], u["mandatory"], u["safe"]) for t, us in plans.items() for k, u in enumerate(us)], "task_id long, unit_id long, place int, tokens long, resolution int, least int, mandatory boolean, safe boolean")
    got = fit_rendered(frame, 1200).collect()
    for t, us in plans.items():
        left, over = gate(us, 1200)
        assert {(r.unit_id, r.resolution, r.overflow) for r in got if r.task_id == t} == {(u["unit_id"], u["resolution"], over) for u in left}


def test_cost_ceiling(spark):
    """The most affordable tokens are within the ceiling as the price is rounded, one more is not; plans under a ceiling keep to it."""
    for model, ceiling in (("claude-3-7-sonnet", 0.005), ("gpt-4o-mini", 0.005), ("o1", 0.0001), ("gpt-4o", 0.123457)):
        n = affordable(ceiling, model)
        price = {"claude-3-7-sonnet": 3.0, "gpt-4o-mini": 0.15, "o1": 15.0, "gpt-4o": 2.5}[model]
        assert (n * price + 1e-9) / 1e6 < ceiling + 0.5e-6 <= ((n + 1) * price + 1e-9) / 1e6
    rows = [(1, i, i + 1, float(i), 900, "SOURCE_FILE", False, None, False, False, False, False, False) for i in range(10)]
    schema = "task_id long, unit_id long, place int, heuristic_score double, tokens long, kind string, unsafe boolean, distance int, is_direct boolean, in_stack_trace boolean, is_failing_test_target boolean, in_compiler_error boolean, in_dirty_diff boolean"
    units = spark.createDataFrame(rows, schema)
    plan = solve_budget(units, 16_000, max_cost=0.005)
    (t,) = plan_totals(units, plan).collect()
    assert t.cost <= 0.005 and t.raw_tokens == 9000 and t.baseline_cost == 0.027 and t.tokens_saved == 9000 - t.total_tokens and t.savings_percentage == round(t.tokens_saved / 90, 1)
    free = solve_budget(units, 16_000).groupBy().sum("token_cost").first()[0]
    assert free > t.total_tokens
