"""Splits, pairs, audits and pairwise models."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import LCG, lcg_jump
from tessera.operators.training import numbered
from tessera.storage import settled


def hash_split(group: Column, train: int = 60, validation: int = 15) -> Column:
    """The split of a group by the first 32 bits of its SHA-256: equal groups are never apart, and no other row matters."""
    h = F.conv(F.substring(F.sha2(group.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < train, "train").when(h < train + validation, "validation").otherwise("test")


def stratified_groups(groups: list[tuple[str, str, int]], test: float = 0.25, validation: float = 0.15, seed: int = 42) -> dict[tuple[str, str], str]:
    """Split of each (repository, group, rows): per repository groups are shuffled by the generator, and fill test, validation and train.

    Groups are a catalogue: one entry for each, however many rows it has.
    """
    a, c, m = LCG
    state, out = seed, {}
    by_repository: dict[str, list[tuple[str, int]]] = {}
    for repository, group, n in groups:
        by_repository.setdefault(repository, []).append((group, n))
    for repository, own in sorted(by_repository.items()):
        order = sorted(own)
        for i in range(len(order) - 1, 0, -1):
            state = (state * a + c) % m
            j = state * (i + 1) // m
            order[i], order[j] = order[j], order[i]
        total = sum(n for _, n in own)
        room = {"test": max(1, int(total * test + 0.5)), "validation": max(1, int(total * validation + 0.5))}
        got = {"test": [], "validation": [], "train": []}
        for group, n in order:
            for split in ("test", "validation"):
                if not got[split] or room[split] >= n:
                    room[split] -= n
                    got[split].append(group)
                    break
            else:
                got["train"].append(group)
        for split in ("train", "validation"):
            if len(order) >= 3 and not got[split] and len(got["test"]) > 1:
                got[split].append(got["test"].pop())
        out |= {(repository, g): split for split, names in got.items() for g in names}
    return out


def stratified_split(rows: DataFrame, test: float = 0.25, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """repository, grp, split of the groups of rows: as stratified_groups. Each repository is a task's work of its own, as the generator can be
    started where the repositories before it have left it: a draw for each group but one."""
    groups = settled(rows.groupBy("repository", "grp").agg(F.count(F.lit(1)).alias("n")), "groups")
    before = numbered(groups.select("repository", "grp"), "repository", "grp").groupBy("repository").agg(F.min("number").alias("groups"))
    before = numbered(before, "repository").select("repository", lcg_jump(seed, F.col("groups") - F.col("number")).alias("state"))

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        own = [(r, g, int(n)) for r, g, n in zip(frame["repository"], frame["grp"], frame["n"], strict=True)]
        out = stratified_groups(own, test, validation, int(frame["state"].iloc[0]))
        return pd.DataFrame([(*k, v) for k, v in out.items()], columns=["repository", "grp", "split"])

    return groups.join(before, "repository").groupBy("repository").applyInPandas(deal, "repository string, grp string, split string")


def split_overlaps(assignments: DataFrame, key: str) -> DataFrame:
    """Keys found in more than one split."""
    return assignments.groupBy(key).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def pairs_within(rows: DataFrame, most: int = 200, value: str | None = None) -> DataFrame:
    """episode_id, positive, negative: each positive with each negative of its episode, at most `most` in order. rows: episode_id, unit_id, label.
    With the name of a column of rows as value: also p and n, the value of the positive and of the negative.

    The cap is the feature: an episode gives a bounded number of pairs. Rows are sorted once: a positive takes from the first `most` negatives
    as many as those before it have left, so that no pair beyond the cap is made.
    """
    order = Window.partitionBy("episode_id").orderBy("unit_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.struct("unit_id", *([value] if value else []))
    ranks = {"_p": F.count_if(F.col("label") == 1).over(order), "_n": F.count_if(F.col("label") == 0).over(order)}
    rows = rows.filter("label IN (0, 1) AND episode_id IS NOT NULL").withColumns(ranks).filter((F.col("label") == 0) & (F.col("_n") <= most) | (F.col("label") == 1) & (F.col("_p") <= most))
    negatives = F.array_sort(F.collect_list(F.when(F.col("label") == 0, held)).over(Window.partitionBy("episode_id")))
    rows = rows.withColumn("_negatives", negatives).filter((F.col("label") == 1) & (F.size("_negatives") > 0))
    room = most - (F.col("_p") - 1) * F.size("_negatives")
    rows = rows.filter(room > 0).withColumn("_negative", F.explode(F.slice("_negatives", F.lit(1), room.cast("int"))))
    out = ["episode_id", F.col("unit_id").alias("positive"), F.col("_negative.unit_id").alias("negative")]
    return rows.select(*out, *([F.col(value).alias("p"), F.col(f"_negative.{value}").alias("n")] if value else []))


def prompt_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " +"), lambda x: x != ""))


#: Longs of the signature by which pairs without enough in common are dropped before their words meet.
SIGNATURE = 3


def _overlap_keys(df: DataFrame, threshold: float) -> DataFrame:
    """id, size, bits, key: of each word set the keys by which it meets all sets that overlap with it by more than the threshold.

    Sizes fall into classes such that two sets that overlap so much are of one class or of neighbouring ones; a set has keys for its own class
    and for the next. In a class no two such sets differ in more than k words, so that of k + 1 shares of all words (by a hash) one at least is
    the same in both: a key is the class, the share and the words in it.
    """
    base = (1 + 1e-9) / threshold
    own = F.floor(F.log("size") / math.log(base))
    top = F.ceil(F.pow(F.lit(base), F.col("class") + 1))  # no set of the class, or of the one before, is larger
    shares = (F.floor(top * (2 * (1 - threshold) / (1 + threshold)) + 1e-6) + 1).cast("int")
    hashes = df.select("id", "words", F.size("words").alias("size"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")).filter("size > 0")
    # Each word turns one bit, so that signatures differ in no more bits than sets in words; large sets don't fill them.
    turned = lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 20), F.lit(64)).cast("int")))
    bits = F.array(*[F.aggregate(F.filter("h", lambda x: F.pmod(F.shiftright(x, 40), F.lit(SIGNATURE)) == i), F.lit(0).cast("long"), turned) for i in range(SIGNATURE)])  # noqa: B023
    rows = hashes.select("id", "size", "h", bits.alias("bits"), F.explode(F.array(own, own + 1)).alias("class")).withColumn("shares", shares)
    held = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda i: F.xxhash64(F.col("class"), i, F.aggregate(F.filter("h", lambda x: F.pmod(x, F.col("shares")) == i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))))
    return rows.select("id", "size", "bits", F.explode(held).alias("key"))


def prompt_overlaps(new: DataFrame, prior: DataFrame, threshold: float = 0.85) -> DataFrame:
    """new_id, prior_id, jaccard of prompts whose word sets overlap by more than the threshold. new, prior: id, prompt.

    Sets meet by keys of several words, of which two such sets share one (see _overlap_keys), so no pair over the threshold is lost, and
    single words make no pairs. Sizes and signatures must allow the overlap before two sets' words are compared.
    """
    words = lambda df: df.select("id", prompt_words(F.col("prompt")).alias("words"))
    a, b = words(new), words(prior)
    x = _overlap_keys(a, threshold).select("key", F.col("id").alias("new"), F.col("size").alias("m"), F.col("bits").alias("p"))
    y = _overlap_keys(b, threshold).select("key", F.col("id").alias("prior"), F.col("size").alias("n"), F.col("bits").alias("q"))
    may = F.least("m", "n") > F.greatest("m", "n") * (threshold - 1e-9)
    differ = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(SIGNATURE)), F.lit(0)) <= (F.col("m") + F.col("n")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    candidates = x.join(y, "key").filter(may & differ).select("new", "prior").distinct()
    shared = F.size(F.array_intersect("new_words", "prior_words"))
    rows = candidates.join(a.select(F.col("id").alias("new"), F.col("words").alias("new_words")), "new").join(b.select(F.col("id").alias("prior"), F.col("words").alias("prior_words")), "prior")
    rows = rows.withColumn("jaccard", shared / (F.size("new_words") + F.size("prior_words") - shared))
    return rows.filter(F.col("jaccard") > threshold).select(F.col("new").alias("new_id"), F.col("prior").alias("prior_id"), "jaccard")


def train_stumps(positive: np.ndarray, negative: np.ndarray, rounds: int = 40, rate: float = 0.08, cuts: int = 80) -> list[tuple[int, float, float, float]]:
    """Boosted stumps on pairs of feature vectors: (feature, threshold, value at most, value above)."""
    sp, sn = np.zeros(len(positive)), np.zeros(len(positive))
    out = []
    grids = [np.unique(np.concatenate([positive[:, f], negative[:, f]])) for f in range(positive.shape[1])]
    grids = [(g[1:] + g[:-1]) / 2 for g in grids]
    grids = [g[np.linspace(0, len(g) - 1, min(len(g), cuts)).astype(int)] if len(g) else g for g in grids]
    for _ in range(rounds):
        gradient = 1 / (1 + np.exp(np.clip(sp - sn, -20, 20)))
        best = (0.0, 0, 0.0, 0.0)
        for f, grid in enumerate(grids):
            for t in grid:
                d = (positive[:, f] <= t).astype(float) - (negative[:, f] <= t)
                n, s = np.abs(d).sum(), (d * gradient).sum()
                if n and s * s / (n + 1) > best[0]:
                    best = s * s / (n + 1), f, float(t), float(s / (n + 1))
        _, f, t, delta = best
        if abs(delta) < 1e-6:
            break
        out.append((f, t, delta / 2, -delta / 2))
        sp += rate * np.where(positive[:, f] <= t, delta / 2, -delta / 2)
        sn += rate * np.where(negative[:, f] <= t, delta / 2, -delta / 2)
    return out


def train_linear(deltas: np.ndarray, rounds: int = 60, rate: float = 0.05, l2: float = 0.01) -> list[float]:
    """Weights of a linear scorer by hinge loss on feature differences, pair after pair."""
    w = np.zeros(deltas.shape[1])
    for _ in range(rounds):
        for d in deltas:
            w += rate * ((d if w @ d < 1 else 0) - l2 * w)
    return w.tolist()


def canonical(value: object) -> str:
    """JSON with sorted keys and without nulls in objects: equal content gives equal text."""
    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if v is not None}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
