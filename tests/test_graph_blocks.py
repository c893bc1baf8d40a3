"""Pairs of keys with many rows: whole, and neither written nor shuffled."""

import glob
import os
import random
from collections import defaultdict

from tessera.operators.graph import configured, neighbourhood, pairs_by_block, resolve_calls


def written(folder):
    return sum(os.path.getsize(p) for p in glob.glob(f"{folder}/**/*.parquet", recursive=True))


def test_pairs_by_block(spark):
    rng = random.Random(1)
    left = [(rng.choice("aab"), i) for i in range(300)] + [(None, -1), ("c", 5)]
    right = [(rng.choice("abd"), i) for i in range(200)] + [(None, -2), ("b", 7), ("b", 7)]
    got = pairs_by_block(spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int"), ["k"], "x", "y", block=16).collect()
    assert sorted((r.k, r.x, r.y) for r in got) == sorted((k, x, y) for k, x in left for m, y in right if k is not None and k == m)


def test_calls_of_one_name_are_not_written(spark, tmp_path):
    spark.conf.set("spark.tessera.folder", f"file://{tmp_path}")
    try:
        uses = spark.range(2000).selectExpr("id + 10000 AS src", "'f' || (id % 3) AS file", "cast(null AS string) AS owner", "'run' AS name")
        symbols = spark.range(1500).selectExpr("id AS dst", "'g' AS file", "cast(null AS string) AS owner", "'run' AS name")
        calls = resolve_calls(uses, symbols)
        assert calls.count() == 2000 * 1500
        assert written(tmp_path) < 200_000
    finally:
        spark.conf.unset("spark.tessera.folder")


def test_neighbours_by_three_hops(spark, tmp_path):
    """Hubs, loops, parallel edges and roots with equal neighbours, against a walk of all paths."""
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(14)]
    e = {(rng.choice(nodes), rng.choice(nodes), rng.choice("XY")) for _ in range(18)} | {(f"s{i}", "n0", "D") for i in range(6)} | {("s0", "s0", "L"), ("n1", "s1", "Z")}
    step = defaultdict(set)
    for a, b, k in e:
        step[a].add((b, k))
        step[b].add((a, k))
    want, starts = set(), [f"s{i}" for i in range(6)] + ["n3", "none"]
    for root in starts:
        seen, frontier = {root}, {root: ""}
        for hop in (1, 2, 3):
            reached = defaultdict(list)
            for node, path in frontier.items():
                for b, k in step[node]:
                    if b not in seen:
                        reached[b].append(f"{path}>{k}" if path else k)
            frontier = {b: min(p) for b, p in reached.items()}
            seen |= set(frontier)
            want |= {(root, b, hop, p) for b, p in frontier.items()}
    edges, roots = spark.createDataFrame(sorted(e), "src string, dst string, kind string"), spark.createDataFrame([(s,) for s in [*starts, "s0"]], "root string")
    for hops in (1, 2, 3):
        got = [(r.root, r.node, r.distance, r.path) for r in neighbourhood(roots, edges, hops).collect()]
        assert set(got) == {w for w in want if w[2] <= hops} and len(got) == len(set(got))


def test_neighbours_of_one_hub_are_not_written(spark, tmp_path):
    spark.conf.set("spark.tessera.folder", f"file://{tmp_path}")
    try:
        edges = spark.range(1200).selectExpr("'s' || id AS src", "'hub' AS dst", "'D' AS kind")
        assert neighbourhood(edges.selectExpr("src AS root"), edges).count() == 1200 + 1200 * 1199
        assert written(tmp_path) < 300_000
    finally:
        spark.conf.unset("spark.tessera.folder")


def test_config_at_the_top_of_many_files(spark):
    files = [(i, f"r/pkg{i % 3}/f{i}.ts") for i in range(500)] + [(900, "r/c.json"), (901, "c.json"), (902, "r/pkg1/c.json")]
    got = [(r.src, r.dst) for r in configured(spark.createDataFrame(files[-3:], "config_id int, path string"), spark.createDataFrame(files, "file_id int, path string")).collect()]
    dirs = {900: "r", 901: "", 902: "r/pkg1"}
    assert sorted(got) == sorted((c, f) for c, d in dirs.items() for f, p in files if p.startswith(d) and f != c)


def test_calls_of_all_levels_are_paired_in_one_stage(spark):
    """Blocks of the levels are put together before their pairs are made, so that these go to what reads them without a copy of each."""
    rng = random.Random(3)
    row = lambda i: (i, rng.choice("ab"), rng.choice(["C", "D", None]), rng.choice("xyz"))
    uses, symbols = [row(i) for i in range(60)], [row(i) for i in range(40, 90)]
    want = set()
    for src, file, owner, name in uses:
        same = [s for s in symbols if s[3] == name]
        for level, near in ((1, [s for s in same if owner is not None and s[1:3] == (file, owner)]), (2, [s for s in same if s[1] == file]), (3, same)):
            if near:
                want |= {(src, s[0], name, level) for s in near if s[0] != src}
                break
    calls = resolve_calls(spark.createDataFrame(uses, "src int, file string, owner string, name string"), spark.createDataFrame(symbols, "dst int, file string, owner string, name string"))
    got = [tuple(r) for r in calls.select("src", "dst", "name", "level").collect()]
    assert set(got) == want and len(got) == len(want)
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Union")


def test_neighbours_of_all_hops_are_paired_in_one_stage(spark):
    """Also where edges stand many times over: they aren't told apart before the least path is taken."""
    edges = [("s1", "n", "D"), ("s2", "n", "D"), ("n", "c1", "K"), ("n", "c2", "A"), ("n", "c2", "B"), ("s3", "m", "D"), ("m", "m", "D")]
    found = neighbourhood(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "root string"), spark.createDataFrame(edges * 3, "src string, dst string, kind string"))
    want = {(a, b, 2, "D>D") for a, b in (("s1", "s2"), ("s2", "s1"))} | {(s, c, 2, p) for s in ("s1", "s2") for c, p in (("c1", "D>K"), ("c2", "D>A"))}
    want |= {("s1", "n", 1, "D"), ("s2", "n", 1, "D"), ("s3", "m", 1, "D")}
    got = [tuple(r) for r in found.select("root", "node", "distance", "path").collect()]
    assert set(got) == want and len(got) == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Union")
