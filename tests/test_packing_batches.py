"""Bundles and the last gate take one step for all tasks of a batch, not task by task in Python."""

from tessera.operators.packing import compose_bundles, fit_rendered


def test_bundles_of_many_tasks_at_once(spark):
    rows = [(t, t * 10 + u, u, 100.0 - 20 * u, 400, f"f{u % 2}" if u else None) for t in range(50) for u in range(4)]
    ranked = spark.createDataFrame(rows, "task_id long, unit_id long, rank int, score double, tokens long, path string").repartition(1)
    links = spark.createDataFrame([(t, t * 10, t * 10 + 3) for t in range(25)], "task_id long, src long, dst long")
    evidence = spark.createDataFrame([(t, "/x/f1") for t in range(0, 50, 2)], "task_id long, path string")
    df = compose_bundles(ranked, links, evidence, max_units=3, max_tokens=1300)
    assert "MapInArrow" in df._jdf.queryExecution().analyzed().toString()
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        got.setdefault(r.task_id, []).append((r.unit_id - r.task_id * 10, r.gain))
    assert got[0] == [(1, 38.0), (0, 10.0), (2, 6.0)] and got[1] == [(0, 10.0), (1, 8.0), (2, 6.0)] and len(got) == 50
    assert got[26] == got[0] and got[27] == got[1]


def test_gate_of_many_tasks_at_once(spark):
    rows = [(t, u, u, 100, 5, 1 + 4 * (u == 1), u == 0, u != 2) for t in range(50) for u in range(1 + t % 4)]
    plan = spark.createDataFrame(rows, "task_id long, unit_id long, place int, tokens long, resolution int, least int, mandatory boolean, safe boolean").repartition(1)
    df = fit_rendered(plan, 210)
    assert "MapInArrow" in df._jdf.queryExecution().analyzed().toString()
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.unit_id):
        got.setdefault(r.task_id, []).append((r.unit_id, r.resolution, r.overflow))
    assert got[0] == [(0, 5, False)] and got[1] == [(0, 5, False), (1, 5, False)]
    assert got[2] == got[6] and not got[2][0][2]
