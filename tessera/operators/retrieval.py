"""Retrieval channels over many tasks at once, and their fusion into candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import exact_tokens, lexical_tokens
from tessera.storage import settled


def top_per(df: DataFrame, key: str, score: str, tie: str, n: int, rank: str = "rank") -> DataFrame:
    """The n best rows of each key, numbered; equal scores in order of tie."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


#: Match types of exact retrieval, the first one that holds counts.
MATCHES = {"path": 1, "qualified_name": 2, "symbol_name": 3}


def evidence_text() -> Column:
    """What exact retrieval reads of a piece of evidence: title and body, or else its trace, or else its message."""
    return F.coalesce(F.when(F.col("title").isNotNull(), F.concat_ws(" ", "title", "body")), F.col("trace"), F.col("message"))


def exact_matches(tasks: DataFrame, units: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """task_id, unit_id, match_type: a token of the prompt or of the evidence's texts equals the unit's path or its last part, its qualified
    name, or its name. Texts of a task are never put together.

    units: unit_id, path, qualified_name, name. evidence: task_id, title, body, trace, message.
    """
    texts = tasks.select("task_id", F.col("prompt").alias("text"))
    if evidence is not None:
        texts = texts.unionByName(evidence.select("task_id", evidence_text().alias("text")).filter("text is not null").join(tasks.select("task_id"), "task_id", "left_semi"))
    tokens = texts.select("task_id", F.explode(exact_tokens(F.col("text"))).alias("token")).distinct()
    last = F.element_at(F.split("path", "/"), -1)
    keys = units.select("unit_id", F.explode(F.array(*[F.struct(c.alias("token"), F.lit(m).alias("match_type"), F.lit(MATCHES[m]).alias("p")) for c, m in ((F.col("path"), "path"), (last, "path"), (F.col("qualified_name"), "qualified_name"), (F.col("name"), "symbol_name"))])).alias("k")).select("unit_id", "k.*")
    return tokens.join(keys.filter("token is not null"), "token").groupBy("task_id", "unit_id").agg(F.min_by("match_type", "p").alias("match_type"))


def _endings(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """df with `ending`: the ends of a column as long as some value of the other side (their distinct lengths are few and sent)."""
    lengths = others.agg(F.collect_set(F.length(other)).alias("lengths"))
    own = F.filter(F.col("lengths"), lambda n: n.between(1, F.length(column)))
    return df.crossJoin(F.broadcast(lengths)).withColumn("ending", F.explode(F.transform(own, lambda n: F.right(F.col(column), n)))).drop("lengths")


def frame_matches(frames: DataFrame, units: DataFrame) -> DataFrame:
    """task_id, unit_id, confidence: a stack frame's file ends with a unit's path or the other way, letter by letter; 1.0 if the frame's function
    is the unit's name or ends its qualified name (case aside), else 0.9.

    Two equi-joins: each side's ends, at the lengths that the other side has, meet the other side's whole paths. Blank paths match nothing.
    frames: task_id, file, function; units: unit_id, path, name, qualified_name (null where a unit is no symbol).
    """
    norm = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    f = frames.select("task_id", F.lower("function").alias("function"), norm(F.col("file")).alias("file")).filter("file <> ''").distinct()
    u = units.select("unit_id", F.lower("name").alias("name"), F.lower("qualified_name").alias("qualified"), norm(F.col("path")).alias("path")).filter("path <> ''")
    files = f.select("file").distinct()
    paths = u.select("path").distinct()
    pairs = _endings(files, "file", paths, "path").join(paths.withColumnRenamed("path", "ending"), "ending").select("file", F.col("ending").alias("path"))
    pairs = pairs.unionByName(_endings(paths, "path", files, "file").join(files.withColumnRenamed("file", "ending"), "ending").select(F.col("ending").alias("file"), "path")).distinct()
    hit = f.join(pairs, "file").join(u, "path")
    agree = (F.col("function") != "") & ((F.col("function") == F.col("name")) | F.col("qualified").endswith(F.col("function")))
    return hit.groupBy("task_id", "unit_id").agg(F.max(F.when(F.coalesce(agree, F.lit(False)), 1.0).otherwise(0.9)).alias("confidence"))


#: Letters of the keys by which needles without any word are found.
GRAM = 6
_BREAK = "[^A-Za-z0-9_]+"


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, key: each text's distinct words, as _BREAK parts them; blank ones are none."""
    word = re.compile("[A-Za-z0-9_]+")
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            block = batch.slice(start, 1024)
            words = [list(set(word.findall(text))) for text in block.column("text").to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(words)), [len(x) for x in words]))
            yield pa.RecordBatch.from_arrays([block.column("h").take(owner), pa.array([w for own in words for w in own], pa.string())], ["h", "key"])


def _candidates(hay: DataFrame, needles: DataFrame, a: str, b: str) -> DataFrame:
    """h, g: hashes of values of hay.a and needles.b (needles distinct) such that all pairs where a contains b are among them; texts don't move.

    Texts are cut once into words, of which those that needles have are kept; again only where needles have no inner word.
    """
    hay, needles = hay.select(a, F.xxhash64(a).alias("h")), needles.filter(F.length(b) > 0).select(b, F.xxhash64(b).alias("g"))
    # The words of a needle between its first and last break stand whole in every text that contains it; the rarest of them is the key.
    parts = F.split(b, _BREAK)
    own = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    inner = needles.select("g", F.explode(F.array_distinct(own)).alias("key"))
    words = hay.select("h", F.col(a).alias("text")).mapInArrow(_distinct_words, "h long, key string")
    known = settled(words.join(inner.select("key").distinct(), "key", "left_semi").select("h", "key"), "known-words")
    counts = known.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = inner.join(counts, "key", "left").groupBy("g").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    found = known.join(rarest, "key").select("h", "g")
    # Needles without such a word: what stands before their first break ends a word of every text that contains them, what stands after
    # their last break begins one, and a needle without a break is within one. They meet the distinct words of all texts, by the whole piece.
    bare = needles.withColumn("parts", parts).filter(F.size(own) == 0)
    if bare.isEmpty():
        return found.distinct()
    head, tail = F.col("parts")[0], F.element_at("parts", -1)
    piece = F.when(F.size("parts") == 1, F.struct(F.lit("in").alias("how"), head.alias("key"))).when((F.length(head) >= F.length(tail)) & (head != ""), F.struct(F.lit("end").alias("how"), head.alias("key"))).when(tail != "", F.struct(F.lit("start").alias("how"), tail.alias("key")))
    pieces = bare.select("g", b, piece.alias("piece"))
    asked = pieces.filter("piece is not null").select("g", "piece.how", "piece.key")
    sizes = asked.select("how", F.length("key").alias("n")).distinct().groupBy("how").agg(F.collect_set("n").alias("sizes"))
    word = F.col("key")
    fits = lambda f: F.transform(F.filter("sizes", lambda n: n <= F.length("word")), f)
    within = F.flatten(fits(lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, n))))
    vocabulary = words.select(word.alias("word")).filter("word <> ''").distinct().crossJoin(F.broadcast(sizes))
    cuts = F.when(F.col("how") == "end", fits(lambda n: F.right(F.col("word"), n))).when(F.col("how") == "start", fits(lambda n: F.left(F.col("word"), n))).otherwise(within)
    met = vocabulary.select("word", "how", F.explode(F.array_distinct(cuts)).alias("key")).join(asked, ["how", "key"]).select(F.col("word").alias("key"), "g")
    found = found.unionByName(words.join(met, "key").select("h", "g"))
    # Needles of breaks alone by their first letters, among all stretches of so many letters.
    if pieces.filter("piece is null").isEmpty():
        return found.distinct()
    short = pieces.filter("piece is null").withColumn("n", F.least(F.lit(GRAM), F.length(b))).withColumn("key", F.left(F.col(b), F.col("n")))
    sizes = short.agg(F.collect_set("n").alias("sizes"))
    grams = F.transform(F.sequence(F.lit(1), F.length(a) - F.col("n") + 1), lambda i: F.substring(F.col(a), i, F.col("n")))
    cut = hay.crossJoin(F.broadcast(sizes)).select("h", a, F.explode("sizes").alias("n")).filter(F.length(a) >= F.col("n")).select("h", F.explode(F.array_distinct(grams)).alias("key"))
    return found.unionByName(cut.join(short.select("g", "key"), "key").select("h", "g")).distinct()


def containing(left: DataFrame, right: DataFrame, a: str, b: str, either: bool = False) -> DataFrame:
    """Pairs where a contains b (either: or b contains a), by equi-joins on a key of the contained text; an empty text is contained in none."""
    hay, needles = (df.select(c).filter(f"{c} is not null") for df, c in ((left, a), (right, b)))
    pairs = _candidates(hay, needles.distinct(), a, b)
    if either:
        pairs = pairs.unionByName(_candidates(needles, hay.distinct(), b, a).select(F.col("g").alias("h"), F.col("h").alias("g"))).distinct()
    test = F.col(a).contains(F.col(b)) & (F.length(b) > 0)
    test = test | (F.col(b).contains(F.col(a)) & (F.length(a) > 0)) if either else test
    rows = left.withColumn("_h", F.xxhash64(a)).join(pairs.select(F.col("h").alias("_h"), F.col("g").alias("_g")), "_h")
    return rows.join(right.withColumn("_g", F.xxhash64(b)), "_g").filter(test).drop("_h", "_g")


#: Weights of fusion: exact match, runtime match, test relationship, lexical score, co-change score.
FUSION = {"exact_match": 5.0, "runtime_match": 6.0, "test_relationship": 2.0, "lexical_score": 2.0, "co_change_score": 2.0}


def fuse(channels: list[DataFrame]) -> DataFrame:
    """One row for each (task, unit): outer union of the channels, the best value of each column, and the set of sources.

    A channel has task_id, unit_id, source and any of the columns of a candidate.
    """
    columns = {"lexical_score": "double", "graph_distance": "int", "co_change_score": "double", "exact_match": "boolean", "test_relationship": "boolean", "runtime_match": "boolean"}
    full = [c.select("task_id", "unit_id", "source", *[F.col(k) if k in c.columns else F.lit(None).cast(t).alias(k) for k, t in columns.items()]) for c in channels]
    union = full[0]
    for c in full[1:]:
        union = union.unionByName(c)
    return union.groupBy("task_id", "unit_id").agg(
        F.max("lexical_score").alias("lexical_score"),
        F.min("graph_distance").alias("graph_distance"),
        F.max("co_change_score").alias("co_change_score"),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("exact_match", "test_relationship", "runtime_match")],
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def fusion_score() -> Column:
    flags = [F.when(F.col(c), F.lit(FUSION[c])).otherwise(0.0) for c in ("exact_match", "runtime_match", "test_relationship")]
    values = [F.coalesce(F.col(c), F.lit(0.0)) * FUSION[c] for c in ("lexical_score", "co_change_score")]
    near = F.when(F.col("graph_distance").isNull(), 0).otherwise(F.greatest(F.lit(0), 3 - F.col("graph_distance")))
    return sum(flags[1:], flags[0]) + values[0] + values[1] + near + F.size("sources")


def overlap_ratio(query: Column, unit: Column) -> Column:
    """The share of the query's token occurrences that are among the unit's tokens."""
    return F.when(F.size(query) > 0, F.size(F.filter(query, lambda x: F.array_contains(unit, x))) / F.size(query)).otherwise(0.0)


def overlap_ratios(candidates: DataFrame, tasks: DataFrame, units: DataFrame) -> DataFrame:
    """task_id, unit_id, overlap_ratio of given candidates (task_id, unit_id): the prompt's tokens with their counts against the unit's, once each.

    Only candidates' texts are cut, and no pair is made that isn't asked for.
    """
    candidates = candidates.select("task_id", "unit_id").distinct()
    units = units.join(candidates.select("unit_id").distinct(), "unit_id", "left_semi")
    q = tasks.select("task_id", lexical_tokens(F.col("prompt")).alias("q")).select("task_id", F.size("q").alias("n"), F.explode("q").alias("w"))
    q = q.groupBy("task_id", "n", "w").agg(F.count(F.lit(1)).alias("k"))
    u = units.select("unit_id", F.explode(F.array_distinct(lexical_tokens(F.col("content")))).alias("w"))
    asked = q.join(candidates, "task_id").select("task_id", "unit_id", "n", "w", "k")
    hit = asked.join(u, ["unit_id", "w"]).groupBy("task_id", "unit_id").agg((F.sum("k") / F.first("n")).alias("r"))
    return candidates.join(hit, ["task_id", "unit_id"], "left").select("task_id", "unit_id", F.coalesce("r", F.lit(0.0)).alias("overlap_ratio"))


def shared_overlap_ratios(tasks: DataFrame, units: DataFrame) -> DataFrame:
    """task_id, unit_id, overlap_ratio of all pairs of task and unit that share a token.

    A unit's tokens stay in one task until they are summed by pair, so that with prompts that are sent to all tasks only pairs are shuffled.
    """
    q = tasks.select("task_id", lexical_tokens(F.col("prompt")).alias("q")).select("task_id", F.size("q").alias("n"), F.explode("q").alias("w"))
    q = q.groupBy("task_id", "n", "w").agg(F.count(F.lit(1)).alias("k"))
    u = units.select("unit_id", F.explode(F.array_distinct(lexical_tokens(F.col("content")))).alias("w"))
    return u.join(q, "w").groupBy("task_id", "unit_id").agg((F.sum("k") / F.first("n")).alias("overlap_ratio"))
