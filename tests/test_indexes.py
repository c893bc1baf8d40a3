"""Ancestry by doubling and substring search by grams, against plain Python."""

import random

from tessera.operators.ancestry import roots
from tessera.operators.snapshots import HashTree
from tessera.operators.substring import LineIndex, grams_of
from tessera.storage import new_folder


def plain_roots(parents):
    out = {}
    for i in parents:
        at, depth, seen = i, 0, {i}
        while parents[at] in parents:
            at, depth = parents[at], depth + 1
            if at in seen:
                at = None
                break
            seen.add(at)
        out[i] = (None, None, True) if at is None else (at, depth, False)
    return out


def got(spark, parents):
    rows = roots(spark.createDataFrame(list(parents.items()), "id long, parent long").repartition(3)).collect()
    assert len(rows) == len(parents)
    return {r.id: (r.root, r.depth, r.cyclic) for r in rows}


def test_roots_of_chains_stars_cycles_and_lost_parents(spark):
    rng = random.Random(1)
    parents = {i: i - 1 if i else None for i in range(1000)}  # a chain
    parents |= {2000 + i: 1999 for i in range(300)} | {1999: -5}  # a star below a row whose parent is not there
    parents |= {3000: 3001, 3001: 3002, 3002: 3000, 3003: 3002, 3004: 3004}  # cycles, and a way into one
    parents |= {4000 + i: 4000 + rng.randrange(i) if i else None for i in range(300)}
    assert got(spark, parents) == plain_roots(parents)


def test_no_rows_and_one_row(spark):
    assert got(spark, {}) == {} and got(spark, {7: None}) == {7: (7, 0, False)} and got(spark, {7: 7}) == {7: (None, None, True)}


def texts(n):
    rng = random.Random(2)
    words = ["needle", "Needle", "é中", "", " ", "aaa", "aaaa", "tion%_", *(f"w{rng.randrange(5000)}" for _ in range(600))]
    return [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 30)))) for i in range(n)] + [(9999, None), (9998, "")]


def test_search_is_the_scan(spark):
    rows = texts(120)
    needles = [(0, "needle"), (1, "aaa"), (2, "aaaaa"), (3, "é"), (4, "é中"), (5, "%_"), (6, "tion%_"), (7, ""), (8, "nowhere at all"), (9, " "), (10, "dle w"), (11, "needle"), (12, "a")]
    index = LineIndex.build(spark.createDataFrame(rows, "unit_id long, content string"), new_folder(spark, "test-lines"), 8)
    want = {(k, i, n) for k, x in needles if x for i, t in rows if t is not None for n, line in enumerate(t.split("\n"), 1) if x in line}
    found = [tuple(r) for r in index.search(spark.createDataFrame(needles, "needle_id long, needle string")).collect()]
    assert set(found) == want and len(found) == len(want)


def test_few_lines_are_tested(spark):
    rows = texts(400)
    index = LineIndex.build(spark.createDataFrame(rows, "unit_id long, content string"), new_folder(spark, "test-lines"), 8)
    needles = spark.createDataFrame([(k, f"w{n} ") for k, n in enumerate(range(0, 5000, 250))], "needle_id long, needle string")
    tested, lines = index.candidates(needles).count(), index.lines.count()
    assert tested < 0.05 * lines * needles.count() and index.search(needles).count() > 0


def test_grams(spark):
    rows = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,), ("é中🙂x",)], "t string")
    assert [sorted(r.g or []) for r in rows.select(grams_of(rows.t).alias("g")).collect()] == [["abc", "bca", "cab"], [], [], [], ["é中🙂", "中🙂x"]]


def test_hash_trees_find_changes_by_few_nodes(spark):
    rng = random.Random(3)
    base = {f"src/{i % 7}/f{i}.ts": f"h{i}" for i in range(5000)}
    held = {"a": base, "b": base | {"src/0/f0.ts": "other", "new/x.ts": "h"}, "c": {k: v for k, v in base.items() if rng.random() > 0.002}, "d": dict(base)}
    files = spark.createDataFrame([(s, p, h) for s, own in held.items() for p, h in own.items()], "snapshot_id string, path string, content_hash string")
    tree = HashTree.build(files, new_folder(spark, "test-tree"), 5000)
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("a", "d"), ("c", "b")]
    asked = spark.createDataFrame(pairs, "old string, new string")
    want = {(x, y, p, "ADDED" if p not in held[x] else "REMOVED" if p not in held[y] else "MODIFIED") for x, y in pairs for p in held[x].keys() | held[y].keys() if held[x].get(p) != held[y].get(p)}
    assert {tuple(r) for r in tree.changes(asked).collect()} == want
    roots_ = {r.snapshot_id: r.node_hash for r in tree.root_hashes().collect()}
    assert roots_["a"] == roots_["d"] != roots_["b"] and len(set(roots_.values())) == 3
    assert sum(x.count() for x in tree.differing(spark.createDataFrame([("a", "b")], "old string, new string"))) <= 2 * len(tree.levels) and len(tree.levels) > 2
