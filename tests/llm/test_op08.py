import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.op08_simhash_tiles import compared, forest, keyed, near_groups, near_links, representatives, units_of

from .conftest import SCHEMA, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile", [2048, 2])
def test_against_brute_force(spark, awkward, tile):
    rng = random.Random(3)
    rows = list(awkward)
    for i in range(20):
        words = prose(rng, 150).split()
        for k in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "Changed"
            rows.append((1000 - 7 * i - k, " ".join(copy), None, None))
    rows += [(3000 + i, f"Tiny{i}", None, None) for i in range(30)]
    got = near_groups(frame(spark, rows), tile=tile).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_links_connect_chains_and_crowds(spark):
    rng = random.Random(5)
    prints = {0}
    x = 0
    for _ in range(40):  # a chain: each three bits from the one before it
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        prints.add(x)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # a crowd around one fingerprint
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=200).collect()
    assert len(links) <= 10 * 30 * len(signed)  # keys, tiles
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        root[find(a)] = find(b)
    x = np.array([p % (1 << 64) for p in signed], dtype=np.uint64)
    want = forest(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3), len(x))
    assert len({find(p) for p in signed}) == len(set(want.tolist()))


def test_empty_table_and_clashing_columns(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = frame(spark, [(4, "a b", None, None), (2, "A B", None, None)]).withColumns({c: F.lit(1) for c in ("fp", "label", "node", "unit")})
    assert {(r.doc_id, r.component_id) for r in near_groups(docs).collect()} == {(4, 2), (2, 2)}


@pytest.mark.parametrize("tile", [60, 7])
def test_crowds_are_laid_in_tiles(spark, tile):
    """Fingerprints that agree in most bits: every pair within the radius is found though keys fill many tiles, pairs of far ones never meet."""
    rng = random.Random(8)
    prints = sorted({sum(1 << b for b in rng.sample(range(30, 64), rng.randrange(1, 12))) for _ in range(700)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame_ = spark.createDataFrame([(p,) for p in signed], "fp long")
    units = units_of(keyed(frame_), 3, tile).collect()
    held = {}
    for r in units:
        held.setdefault(r.unit, []).append((r.side, r.fp % (1 << 64)))
    for rows in held.values():
        one, two = ([p.bit_count() for s, p in rows if s == k] for k in (1, 2))
        assert len(rows) <= 4 * tile
        if one or two:
            assert not [p for s, p in rows if s == 0] and max(min(two) - max(one), min(one) - max(two)) <= 3
    x = np.array(prints, dtype=np.uint64)
    want = forest(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3), len(x))
    place = {p: i for i, p in enumerate(prints)}
    links = [(place[r.a % (1 << 64)], place[r.b % (1 << 64)]) for r in near_links(frame_, tile=tile).collect()]
    got = forest(np.array([a for a, _ in links]), np.array([b for _, b in links]), len(x))
    assert got.tolist() == want.tolist()


def test_compared_finds_each_pair_once():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 1 << 12, n, dtype=np.uint64) for n in (700, 300))
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= 3
    assert sorted(zip(*map(np.ndarray.tolist, compared(x, y, 3)), strict=True)) == list(map(tuple, np.argwhere(near).tolist()))
    got = [tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, compared(x, None, 3)), strict=True)]
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    assert sorted(got) == list(map(tuple, near.tolist()))


def test_representatives_are_chosen_by_row(spark):
    """Rows of one id with different texts are documents of their own; of equal rows one stays; names of columns don't matter."""
    a, b = "one text " * 30, " ".join(f"other{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, "third text here"), (9, "third text here"), (None, "third text here"), (None, "alone " * 9), (None, "alone " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["row", "fp", "k1", "k2", "k3", "label", "node", "first", "stays", "n", "none", "unit", "key", "ones", "side", "tile"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    got = representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (9, "third text here"), (None, "alone " * 9)], key=str)
    assert all(r[c] == f"own {c}" for r in got.collect() for c in names)
    assert representatives(spark.createDataFrame([], SCHEMA)).collect() == []
