import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.op13_prefix_trie import numbered, prefix_sums, trie

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members, children = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, convs in members.items():
        below = [node]
        for x in below:
            below += children.get(x, [])
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), sum(x not in children for x in below), saved, digest))
    return sorted(out, key=str)


def chats(seed, n, vocabulary, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice([None, "", *(f"t{i} says {'so ' * i}" for i in range(vocabulary))])))
    return rows


def got(spark, rows, **more):
    return sorted(map(tuple, trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()), key=str)


def test_against_brute_force(spark):
    rows = chats(1, 150, 2)
    rows += [(c + 10_000, t, r, x) for c, t, r, x in rows] + [(None, 0, "user", "no conversation")]  # copies, and a row without one
    assert got(spark, rows) == brute(rows)


def test_awkward_turns(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(400, 700) for t in range(3)]
    rows = [(20, None, "user", "first"), (20, 5, "user", "last"), (20, -1, None, None), (41, 0, "user", ""), (60, 0, "a", "bc"), (61, 0, "ab", "c"), (80, 0, "user", "word " * 30_000), (81, 1, "user", "word " * 30_000), (-5, 0, "user", "below zero"), (-40, 0, "user", "x")]
    assert got(spark, copies + rows) == brute(copies + rows)
    assert got(spark, []) == []


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(c, t, "user", "same") for c in (0, 1, 2) for t in (0, 0, 1)]
    assert got(spark, rows) == brute(rows)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(40, t, "user", f"turn {rng.randrange(50)}") for t in range(600)] + [(41, t, "user", "short") for t in range(5)] + [(c, 0, "user", "one") for c in range(42, 59)]
    assert got(spark, rows) == brute(rows)
    sums = prefix_sums(numbered(spark.createDataFrame(rows, SCHEMA)), (3, 5)).filter("_conv = 40").orderBy("_rank").collect()
    by_turn = {r._rank: r for r in sums}
    assert sorted(by_turn) == list(range(1, 601))
    total = 0
    for k in range(1, 601):
        total = (total + by_turn[k]._a * 3**k) % 2**64
        assert by_turn[k]._sa % 2**64 == total


@pytest.mark.parametrize(("bits", "bases"), [(2, (3, 5)), (64, (1, 1)), (3, (1, 1))])
def test_collisions_are_split(spark, bits, bases):
    """Numbers of few bits, and bases that forget the order of turns."""
    rows = chats(4, 60, 3, 5)
    assert got(spark, rows, bits=bits, bases=bases) == brute(rows)


def test_columns_of_any_name(spark):
    rows = chats(5, 30, 2)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_conv", "_depth", "depth", "_p", "n_convs", "_row", "_part")})
    assert sorted(map(tuple, trie(df).collect()), key=str) == brute(rows)
