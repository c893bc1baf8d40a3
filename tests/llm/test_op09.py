import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.op09_robust_outliers import DIMENSIONS, FLOORS, UNITS, accepted, estimates, quality_verdicts

from .conftest import SCHEMA, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def vector(text):
    n, chars, symbols, _, repeat, _ = base(text)
    upper = sum(c.isupper() and c.lower() != c for c in text)
    return [chars / n, (symbols / chars) ** 0.5, (upper / chars) ** 0.5, (repeat / n) ** 0.5]


def least_determinant(x, rng, share=0.75, starts=200):
    """The estimate by many random starts, on the same grid: (distances of x, logarithm of the determinant)."""
    unit = np.array([UNITS[d] for d in DIMENSIONS])
    grid = np.rint(x / unit) * unit
    floor = np.diag(np.array([FLOORS[d] for d in DIMENSIONS]) ** 2)
    h = int(np.ceil(share * len(x)))
    best = None
    for _ in range(starts):
        near = grid[rng.choice(len(x), 10, replace=False)]
        before = np.inf
        while True:
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floor
            logdet = np.linalg.slogdet(cov)[1]
            if len(near) == h and logdet >= before - 1e-12:
                break
            before = logdet if len(near) == h else np.inf
            d = np.einsum("ij,jk,ik->i", grid - mean, np.linalg.inv(cov), grid - mean)
            near = grid[np.lexsort((*grid.T[::-1], d))[:h]]
        if best is None or logdet < best[0] - 1e-9:
            best = logdet, mean, np.linalg.inv(cov)
    logdet, mean, inverse = best
    distance = lambda v: np.einsum("ij,jk,ik->i", v - mean, inverse, v - mean)
    middle = np.sort(distance(grid))[(len(x) + 1) // 2 - 1]
    return distance(x) / max(1.0, middle / 3.356694), logdet


def test_base_statistics(spark, awkward):
    rng = random.Random(2)
    rows = [*awkward, (900, "a b c a b c a b c d", "en", "s"), (901, "x y z\n" * 40, "en", "s"), (902, "a a a a", "en", "s"), (903, "#<>|&%$*## w\n\n \nw\nw", None, None), (904, " ".join(rng.choice("abc") for _ in range(400)), "en", "s")]
    got = quality_verdicts(frame(spark, rows)).collect()
    want = sorted(((r[0], *base(r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert not any(r.kept and r.base_failed for r in got)


def clustered(rng, n):
    """Texts of one kind, and a fifth in a far, tight cluster that draws classical estimates to itself."""
    rows = []
    for i in range(n):
        words = prose(rng, 120, 4000).split()
        if i % 30 == 0:
            words = [w + "###" for w in words]
        if i % 5 == 1:
            words = [w.upper() + "longer" for w in words]
        rows.append(" ".join(words))
    return rows


def test_distances_and_groups(spark):
    """Equal to the least determinant of many random starts, with planted clusters; alike for any partitioning."""
    rng = random.Random(4)
    rows = [(i, t, "en" if i < 300 else "de", "s1" if i < 250 else None) for i, t in enumerate(clustered(rng, 420))]
    docs = frame(spark, rows)
    first = quality_verdicts(docs, least_rows=100).collect()
    got = {r.doc_id: r for r in first}
    random_starts = np.random.default_rng(1)
    for group in (range(250), range(300, 420)):  # (en, s1) and (de, null) have their own estimates; (en, null) uses that of en
        want, _ = least_determinant(np.array([vector(rows[i][1]) for i in group]), random_starts)
        assert np.allclose([got[i].distance for i in group], want, rtol=0.02, atol=0.02)
    want = least_determinant(np.array([vector(rows[i][1]) for i in range(300)]), random_starts)[0][250:]
    assert np.allclose([got[i].distance for i in range(250, 300)], want, rtol=0.02, atol=0.02)
    assert all(got[i].kept == (i % 30 != 0 and i % 5 != 1) for i in range(420))
    for n in (1, 7):
        assert sorted(map(str, quality_verdicts(docs.repartition(n), least_rows=100).collect())) == sorted(map(str, first))


def test_estimate_is_a_fixed_point_of_least_determinant(spark):
    """The nearest rows by the estimate give the estimate again; its determinant is about the least that 200 random starts find."""
    rng = random.Random(14)
    x = np.array([vector(t) for t in clustered(rng, 150)])
    unit = np.array([UNITS[d] for d in DIMENSIONS])
    grid = np.rint(x / unit)
    cells = Counter(map(tuple, grid.astype(int).tolist()))
    table = spark.createDataFrame([("g", *map(int, c), n, len(x)) for c, n in cells.items()], "`group` string, q_0 long, q_1 long, q_2 long, q_3 long, n long, rows long")
    few, many = (estimates(table, draws=n).first() for n in (0, 6))
    assert many.logdet <= few.logdet + 1e-9
    least = least_determinant(x, np.random.default_rng(2))[1]
    assert least - 1e-9 <= many.logdet < least + 0.01
    for e in (few, many):
        mean, factor = np.array([e[f"m_{i}"] for i in range(4)]), np.array([[e[f"l_{i}_{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        d = (np.linalg.solve(factor, (grid * unit - mean).T) ** 2).sum(axis=0)
        near = (grid * unit)[np.lexsort((*grid.T[::-1], d))[: int(np.ceil(0.75 * len(x)))]]
        assert np.allclose(near.mean(axis=0), mean) and np.allclose(np.cov(near.T, bias=True) + np.diag([FLOORS[k] ** 2 for k in DIMENSIONS]), factor @ factor.T)


def test_accepted_carries_columns_of_any_name(spark):
    names = ["k1", "k2", "_k1", "_k2", "row", "kind", "group", "kept", "distance", "f_length", "q_0", "m_0", "l_0_0", "scale", "words", "_d2", "logdet", "n_words"]
    docs = frame(spark, [(i, " ".join(f"word{i + k}" for k in range(60)), "en", "s") for i in range(50)] + [(99, "short", None, None), (None, None, None, None)]).withColumns({c: F.lit(f"own {c}") for c in names})
    got = accepted(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(50)) and all(r[c] == f"own {c}" for r in rows for c in names)


def test_empty_table_and_clashing_columns(spark):
    assert quality_verdicts(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = frame(spark, [(1, None, None, None), (2, "word " * 60, None, None)]).withColumns({c: F.lit(1) for c in ("words", "group", "kind", "f_length", "n_words")})
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in quality_verdicts(docs).collect()) == [(1, True, False), (2, True, False)]


def test_tables_and_capitals_are_outliers(spark):
    """Texts with a symbol in every second word, or far more capitals than the others, go; their group stays."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = prose(rng, 120, 4000).split()
        if i % 50 == 7:
            words = [w[:-1] + "|" if k % 2 else w for k, w in enumerate(words)]
        capitals = 40 if i % 50 == 9 else 8 + i % 5
        rows.append((i, " ".join(w.upper() if k < capitals else w for k, w in enumerate(words)), "en", "s1"))
    got = {r.doc_id: r for r in quality_verdicts(frame(spark, rows)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {i for i in range(300) if i % 50 in (7, 9)}
