"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Protected entities are found by pattern (e-mail address, IP address, payment card, telephone number). Corpus co-occurrence then tells
how strongly a term (a word without digits, @ and +, in lower case) reveals an entity: with documents as contexts,
    PMI(e; t) = log2(p(e, t) / (p(e) p(t))),    IC(e) = -log2 p(e),
and t discloses e if PMI(e; t) >= IC(e) - SLACK, that is if it leaves at most SLACK bits of what e tells: p(e | t) >= 2 ** -SLACK. Such
terms are marked wherever they stand and generalised in the sanitised text, as are the entities themselves.

Chance can't be told from disclosure in a few contexts, so an entity, and a pair of entity and term, must be found in at least SUPPORT
distinct texts. That prunes exactly: entities below it are dropped before any pair is formed, and pairs are counted only in
documents that hold an entity above it, with terms that are found at most 2 ** SLACK times as often as the entity (others can't
disclose it), so a directory of many entities doesn't meet its common words. Counts cover all documents.

Null text counts as empty. A null doc_id, repeated rows and equal ids are rows of their own. Texts and rows are named by two 64-bit
hashes (of the text; of id and text), so that one collision doesn't mark a text with another's terms. An empty
table gives no rows; other columns are ignored. Offsets are in code points, ends exclusive. Patterns are possessive, so very long
runs cost linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD, matched, sent, written

#: The base patterns. Look-behind and \G (the end of the last match) only spare starts inside a run that fail as its first letter did.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A letter without which a text can't match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = [*PATTERNS, "term"]
SUPPORT = 3
SLACK = 1.0
_BLOCK = 32


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, k: Column) -> Column:  # k-th digit from the right
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(k % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, m: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(m) if kind == "email" else m if kind == "ip" else _digits(m))


def _of(f: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    return lambda x: f(kind, x["match"])


def with_matches(df: DataFrame, name: str, pattern: str, needs: str | None = None) -> DataFrame:
    """Adds `name`: array of (start, end, match) of the leftmost non-overlapping matches of pattern in _text.

    The text between matches gives their offsets: sums of lengths, over blocks of _BLOCK matches and then within a block.
    """
    text, zero = F.col("_text"), F.lit(0)
    could = F.lit(True) if needs is None else F.contains(text, F.lit(needs))
    df = df.withColumn("_m", F.when(could, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_l", F.transform("_m", lambda m, i: F.length(m) + F.get(F.col("_g"), i)))
    blocks = F.sequence(zero, F.floor((F.size("_l") - 1) / _BLOCK).cast("int"))
    total = lambda x: F.aggregate(x, zero, lambda acc, v: acc + v)
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.transform(blocks, lambda b: total(F.slice(F.col("_l"), b * _BLOCK + 1, F.lit(_BLOCK))))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_p", F.transform("_s", lambda _, b: total(F.slice(F.col("_s"), F.lit(1), b))))

    def place(m: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(F.col("_p"), block) + total(F.slice(F.col("_l"), block * _BLOCK + 1, i % _BLOCK)) + F.get(F.col("_g"), i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"))

    return df.withColumn(name, F.transform("_m", place)).drop("_m", "_g", "_l", "_s", "_p")


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    names = [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_k2")]
    return docs.select(F.col("doc_id").alias("doc_id"), *names, F.coalesce("text", F.lit("")).alias("_text"), *more)


ROW = ["_k1", "_k2"]
TEXT = ["_h1", "_h2"]


def _text_names() -> list[Column]:
    return [F.xxhash64("_text").alias("_h1"), F.xxhash64(F.lit(1), "_text").alias("_h2")]


def _span(kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _spans_of(kind: str) -> Callable[[Column], Column]:
    return lambda x: _span(kind, x)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _k1 and _k2 (of the row), _h1 and _h2 (of the text), n_email, n_ip, n_card, n_phone, _spans (start, rank, end, kind; in order), _entities."""
    df = _texts(docs)
    for kind, pattern in PATTERNS.items():
        df = with_matches(df, f"_{kind}", pattern, NEEDS.get(kind))
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", _of(_holds, kind)))
    spans = F.sort_array(F.concat(*[F.transform(f"_{k}", _spans_of(k)) for k in PATTERNS]))
    entities = F.array_distinct(F.concat(*[F.transform(f"_{k}", _of(_entity, k)) for k in PATTERNS]))
    return df.select("doc_id", *ROW, *_text_names(), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], spans.alias("_spans"), entities.alias("_entities"))


def _terms() -> Column:
    """The distinct terms of _text."""
    words = F.array_distinct(F.split(F.lower("_text"), f"[{SPACE}]+"))
    return F.filter(words, lambda w: w.rlike("^[^0-9@+]+$"))


def disclosing_terms(docs: DataFrame, base: DataFrame, support: int = SUPPORT, slack: float = SLACK) -> DataFrame | None:
    """term, and information left (bits) of the entity that it discloses most of; None if no entity has enough support."""
    held = base.filter("size(_entities) > 0").select(*TEXT, F.explode("_entities").alias("entity"))
    per_text = written(held.groupBy("entity", *TEXT).agg(F.count(F.lit(1)).alias("n")), "text-entities")
    entities = written(per_text.groupBy("entity").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support).drop("texts"), "entities")
    if entities.isEmpty():
        return None
    chosen = written(per_text.join(sent(entities), "entity"), "entity-texts")
    most = chosen.agg(F.max("all")).first()[0] * 2.0**slack
    # A term must be in as many documents as a pair needs texts, and in few enough to leave so little of the most frequent entity.
    counts = _texts(docs).select(F.explode(_terms()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("found"))
    counts = written(counts.filter(F.col("found").between(support, most)), "term-counts")
    # A text that several rows share is split into terms once, whatever their ids; n counts all of its rows.
    keys = written(chosen.select(*TEXT).distinct(), "texts-with-entities")
    texts = matched(_texts(docs).select(*_text_names(), "_text"), keys, TEXT).dropDuplicates(TEXT)
    terms = texts.select(*TEXT, F.explode(_terms()).alias("term")).join(sent(counts), "term")
    pairs = terms.join(chosen, TEXT).filter(F.col("found") <= F.col("all") * 2.0**slack)
    pairs = pairs.groupBy("entity", "term", "found").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    left = F.log2(F.col("found") / F.col("both"))  # IC(e) - PMI(e; t) = -log2 p(e | t)
    found = pairs.withColumn("left", left).filter(F.col("left") <= slack)
    return written(found.groupBy("term").agg(F.min("left").alias("left")), "disclosing-terms")


def marked(docs: DataFrame, support: int = SUPPORT, slack: float = SLACK) -> DataFrame:
    """The columns of base_spans, with the spans of disclosing terms (kind term) in _all."""
    base = written(base_spans(docs), "base-spans")
    terms = disclosing_terms(docs, base, support, slack)
    if terms is None or terms.isEmpty():
        return base.withColumn("_all", F.col("_spans"))
    found = _texts(docs).select(*ROW, F.explode(_terms()).alias("term")).join(sent(terms.select("term")), "term")
    found = written(found.groupBy(*ROW).agg(F.collect_set("term").alias("_found")), "term-documents")
    places = with_matches(matched(_texts(docs), found, ROW).dropDuplicates(ROW), "_words", WORD)
    hit = F.filter("_words", lambda x: F.array_contains(F.col("_found"), F.lower(x["match"])))
    places = places.select(*ROW, F.transform(hit, _spans_of("term")).alias("_terms"))
    return base.join(places, ROW, "left").withColumn("_all", F.sort_array(F.concat("_spans", F.coalesce("_terms", F.slice("_spans", 1, 0))))).drop("_terms")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def private_spans(docs: DataFrame, support: int = SUPPORT, slack: float = SLACK) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of each row."""
    rows = marked(docs, support, slack)
    return rows.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(_listed("_spans"), 256).alias("base_sha256"), _listed("_all").alias("spans"), (F.size("_all") - F.size("_spans")).cast("long").alias("n_term"))


def sanitised(docs: DataFrame, support: int = SUPPORT, slack: float = SLACK) -> DataFrame:
    """doc_id and text, with entities and disclosing terms generalised to the name of their kind."""
    rows = _texts(docs).join(marked(docs, support, slack).select(*ROW, "_all").dropDuplicates(ROW), ROW)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("_text")

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_all", state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.select("doc_id", done.alias("text"))
