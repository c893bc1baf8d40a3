import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.op02_disclosure import private_spans, sanitised

from .conftest import SCHEMA, frame, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def entity(kind, m):
    return kind, m.lower() if kind == "email" else m if kind == "ip" else re.sub("[^0-9]", "", m)


def base(text):
    return [(m.start(), KINDS.index(k), m.end(), entity(k, m.group())) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def terms(text):
    return {w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if re.fullmatch(r"[^0-9@+]+", w)}


def brute(rows, support=3, slack=1.0):
    texts = [r[1] or "" for r in rows]
    of, pair, contexts, n = defaultdict(set), defaultdict(int), defaultdict(set), defaultdict(int)
    for t in texts:
        for e in {s[3] for s in base(t)}:
            of[e].add(t)
        for w in terms(t):
            n[w] += 1
    for t in texts:
        for e in {s[3] for s in base(t)}:
            if len(of[e]) >= support:
                for w in terms(t):
                    pair[e, w] += 1
                    contexts[e, w].add(t)
    bad = {w for (e, w), c in pair.items() if len(contexts[e, w]) >= support and math.log2(n[w] / c) <= slack}
    out = []
    for r, t in zip(rows, texts, strict=True):
        spans = sorted(s[:3] for s in base(t))
        more = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if m.group().lower() in bad]
        show = lambda x: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
        out.append((r[0], *[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(show(spans).encode()).hexdigest(), show(spans + more), len(more)))
    return sorted(out, key=str)


def data():
    rng = random.Random(8)
    pieces = ["a.b@c.d_e@f.g", "x@y", "é.z+w@m-n.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0)30 1234567", "+1.", "+12345678901234567", "0" * 40, "9.9.9.9", "a@b.c.", "🙂@b.c", "7" * 3000, "a" * 3000 + "@", "+1" + "-" * 500, "1.2.3", "....", "@@", "a@b..c", "-a@-b.-", "+1 (017) 555-7713", "4111111111111111 4111111111111111"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(1, 9))) + "\n" + prose(rng, 20), None, None) for i in range(120)]
    rows += [(500 + i, f"{prose(rng, 15)} Zanzibar quetzal{'' if i % 4 else ' common'} secret@agency.example {prose(rng, 5)}", None, None) for i in range(8)]
    rows += [(600 + i, f"{prose(rng, 15)} zanzibar {'quetzal' if i < 1 else 'w1'} common", None, None) for i in range(12)]
    rows += [(700, "10.0.0.1 " * 200, None, None), (701, "10.0.0.2 " * 200, None, None)]
    return rows


def test_against_brute_force(spark, awkward):
    rows = awkward + data()
    got = private_spans(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert any(r.n_term for r in got)


@pytest.mark.parametrize(("support", "slack"), [(1, 0.0), (2, 2.0)])
def test_thresholds(spark, support, slack):
    rows = data()
    assert sorted(map(tuple, private_spans(frame(spark, rows), support, slack).collect()), key=str) == brute(rows, support, slack)


def test_sanitised_text(spark):
    docs = frame(spark, [(1, "write to a.b@c.de or 9.9.9.9 now", None, None), (2, None, None, None), (3, "+49 30 1234567, 4111 1111 1111 1111", None, None)])
    assert {r.doc_id: r.text for r in sanitised(docs).collect()} == {1: "write to [EMAIL] or [IP] now", 2: "", 3: "[PHONE], [CARD]"}


def test_empty_table_and_clashing_columns(spark):
    assert private_spans(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = frame(spark, [(1, "a@b.c", None, None)]).withColumns({c: F.lit(1) for c in ("_key", "_text", "spans", "term", "entity", "n")})
    assert [(r.n_email, r.spans) for r in private_spans(docs).collect()] == [(1, "email:0:5")]


def test_copies_under_different_ids(spark):
    """A term of 100 copies and two other texts, all with one entity, occurs nowhere else."""
    rows = [(i, "Zanzibar secret@agency.example and more", None, None) for i in range(100)]
    rows += [(100, "zanzibar one secret@agency.example", None, None), (101, "the zanzibar secret@agency.example", None, None)]
    rows += [(200 + i, "one and the more", None, None) for i in range(300)]
    got = private_spans(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(r.n_term for r in got) == 102
