import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import op10_patience_lines
from tessera.llm.common import written
from tessera.llm.op10_patience_lines import aligned_lines, line_digest, line_hashes, patience, without_common_lines

from .conftest import SCHEMA, frame, prose


def words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def units(lines, least):
    """From each line with a word on: as few lines as have `least` words."""
    out = []
    for i, x in enumerate(lines):
        n, e = 0, i
        while words(x) and e < len(lines) and n < least:
            n, e = n + words(lines[e]), e + 1
        if n >= least:
            out.append("\n".join(lines[i:e]))
    return set(out)


def brute(rows, rare, least):
    """All pairs that the rule names, aligned on the lines themselves."""
    lines = [(r[1] or "").split("\n") for r in rows]
    held = [units(ls, least) if r[0] is not None else set() for r, ls in zip(rows, lines, strict=True)]
    count, owner = {}, {}
    for k, r in enumerate(rows):
        for x in held[k]:
            count[x] = count.get(x, 0) + 1
            if x not in owner or r[0] < rows[owner[x]][0]:
                owner[x] = k
    out = []
    for r, ls, own in zip(rows, lines, held, strict=True):
        gone = set()
        found = {(count[x], owner[x]) for x in own if rows[owner[x]][0] < r[0]}
        rarest = min((n for n, _ in found), default=0)
        for n, o in found:
            if n <= max(rare, rarest):
                gone.update(j for j, _ in aligned_lines(lines[o], ls, [words(x) for x in ls], least))
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out.append((r[0], len(ls), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    pool = [prose(rng, rng.randrange(2, 12), 3000).replace("\n", "") for _ in range(60)]
    rows = []
    for i in range(80):
        ls = [prose(rng, rng.randrange(1, 14), 3000).replace("\n", "") for _ in range(rng.randrange(0, 8))]
        at = rng.randrange(50)
        ls[2:2] = pool[at : at + rng.randrange(0, 6)]
        if i % 2:
            ls.insert(0, "a line of six words everywhere")
        if rows and i % 9 == 0:
            ls = rng.choice(rows)[1].split("\n") + ls[:1]
        rows.append((2000 - 3 * i, "\n".join(ls), None, None))
    return rows


def test_against_brute_force(spark, awkward):
    rows = [r for r in awkward if r[0] != 5] + corpus(random.Random(6))
    for rare in (100, 2):
        got = line_digest(frame(spark, rows), rare).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, rare, 5)
    assert sum(r.n_removed for r in got) > 50


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        m = patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert patience([1, 2, 2, 3], [1, 2, 2, 3]) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_copies_and_carried_columns(spark):
    text = "one line of these five\nand another line of six words"
    names = ["row", "k1", "k2", "e1", "e2", "lines", "words", "units", "unit", "owner", "last", "n", "pairs", "i", "j", "line", "gone", "kept", "n_lines", "n_removed", "wanted", "_key", "_gone", "_n_removed"]
    docs = frame(spark, [(i, text, "en", f"s{i}") for i in (4, 9, 2)] + [(1, "other words stand here alone", None, None)]).withColumns({c: F.lit(f"own {c}") for c in names})
    rows = without_common_lines(docs)
    assert rows.select("row.*").columns == docs.columns and rows.columns == ["row", "n_lines", "n_removed"]
    got = {r.row.doc_id: r for r in rows.collect()}
    assert {i: r.row.text for i, r in got.items()} == {1: "other words stand here alone", 2: text, 4: "", 9: ""}
    assert got[9].row.source == "s9" and got[9].n_removed == 2 and got[1].n_lines == 1
    assert all(r.row[c] == f"own {c}" for r in got.values() for c in names)


def test_passages_of_short_lines(spark):
    """A passage of one-word lines is found though no line of it has five words."""
    verse = "\n".join("the old grey sea runs on and on".split())
    rows = [(1, f"first\n{verse}\n\nend", None, None), (2, f"{verse}\nsecond", None, None), (3, f"third\n\nthe\nold\ngrey", None, None)]
    got = {r.doc_id: r.n_removed for r in line_digest(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 8, 3: 0}


def test_hashes_alone_remove_nothing(spark, monkeypatch):
    """With hashes that tell lines apart by their length only, lines still go by their letters."""
    def poor(data, offsets, least):
        firsts, hashes, words_, edges, units_ = line_hashes(data, offsets, least)
        same = lambda x: np.full_like(x, 7)
        return firsts, same(hashes), words_, edges, same(units_)

    monkeypatch.setattr(op10_patience_lines, "line_hashes", poor)
    rows = [(1, "five words are in here\nand in this line too", None, None), (2, "five words are in here\nother words are in this", None, None), (3, "nothing of this is there\nnor is any of that", None, None)]
    assert {r.doc_id: r.n_removed for r in line_digest(frame(spark, rows)).collect()} == {1: 0, 2: 1, 3: 0}


def test_empty_table(spark):
    assert line_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_owners_of_lines_of_over_100_documents(spark):
    """Each document shares a rarer line with one that doesn't hold the common passage."""
    passage = "the first line of a passage\nand its second line goes on here"
    rows = [(0, passage, None, None)]
    for i in range(1, 120):
        own = f"line {i} is in two documents"
        rows += [(i, own, None, None), (1000 + i, f"{own}\nbetween {i}\n{passage}", None, None)]
    got = line_digest(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, len(rows), 5)
    assert all(r.n_removed == 3 for r in got if r.doc_id > 1000)


def test_a_long_owner_of_a_frequent_line_goes_to_lots_not_to_documents(spark, monkeypatch):
    """Half of the documents share one line of an owner with thousands of lines: its lines are dealt out once a lot."""
    line = "all of these documents hold this one line"
    owner = "\n".join([*(f"own line number {i} of the long one" for i in range(3000)), line])
    rows = [(1, owner, "en", "s")] + [(i, f"{line}\nand a line of document {i} alone" if i % 2 else f"nothing shared in document {i} at all", "en", "s") for i in range(2, 1202)]
    monkeypatch.setattr("tessera.llm.op10_patience_lines.LOT", 100)
    tables = {}

    def kept(df, tag):
        tables[tag] = written(df, tag)
        return tables[tag]

    monkeypatch.setattr("tessera.llm.op10_patience_lines.written", kept)
    got = sorted(map(tuple, line_digest(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows, len(rows), 5)
    assert tables["line-lots"].agg({"lots": "sum"}).first()[0] == 6 and tables["line-pairs"].count() == 600
