"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of each whole text (ratios of symbols, upper-case letters, digits, repeated words and so on) are column expressions.
2. Small trees are grown on a sample of labelled rows, each on a random share of rows and statistics; every path from a root to a node
   is a rule: a conjunction of bounds on statistics.
3. Logistic regression with a lasso penalty, fitted by proximal gradient steps, keeps few of the rules.
4. These become one Spark column expression, which scores every document.

Fitting sees at most `most_rows` labelled rows (those with the least hash of doc_id), never rows whose crc32(doc_id) mod 5 is 0;
labels, lang, source and doc_id are not statistics. Null and empty texts have all statistics 0 and are scored like any other. A null
quality is no label; where a doc_id has several labels the greatest counts. With no label the score is 0.5. A null doc_id is not held
out. Repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textstats import base_statistics

#: The most labelled rows that fitting sees.
MOST_ROWS = 20_000
THRESHOLD = 0.3


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, keep: list[Column]) -> tuple[DataFrame, list[str]]:
    """keep and the statistics of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = {
        "_pipes": F.regexp_count(text, F.lit(r"\|")),
        "_marks": F.regexp_count(text, F.lit("[!?]")),
        "_digits": F.regexp_count(text, F.lit("[0-9]")),
        "_stops": F.regexp_count(text, F.lit("[.,;:]")),
        "_lines": F.regexp_count(text, F.lit("\n")) + 1,
    }
    df = base_statistics(docs, [*keep, *[c.alias(k) for k, c in more.items()]])
    n, chars = F.col("n_words"), F.col("word_chars")
    stats = {
        "s_size": F.log1p(n),
        "s_word_length": _ratio(chars, n),
        "s_symbols": _ratio(F.col("n_symbols"), n),
        "s_upper": _ratio(F.col("n_upper"), chars),
        "s_repeat": _ratio(F.col("n_repeat_words"), n),
        "s_same_lines": _ratio(F.col("n_dup_lines"), F.col("_lines")),
        "s_line_words": _ratio(n, F.col("_lines")),
        "s_pipes": _ratio(F.col("_pipes"), n),
        "s_marks": _ratio(F.col("_marks"), n),
        "s_digits": _ratio(F.col("_digits"), chars),
        "s_stops": _ratio(F.col("_stops"), n),
    }
    kept = [c for c in df.columns if not c.startswith("_") and c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")]
    return df.select(*kept, *[c.cast("double").alias(k) for k, c in stats.items()]), list(stats)


#: A bound on statistic k: above (True) or at most (False) a value. A rule is a set of bounds that all hold.
Bound = tuple[int, bool, float]
Rule = tuple[Bound, ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, value in rule:
        out &= (x[:, k] > value) == above
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int, tried: np.ndarray, least: int, cuts: int, path: Rule = ()) -> list[Rule]:
    """The paths to all nodes of a tree, each split where the classes' variance falls most."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return []
    best = None
    for k in tried.tolist():
        for value in np.unique(np.quantile(x[:, k], np.linspace(0, 1, cuts + 2)[1:-1])).tolist():
            side = x[:, k] > value
            n = int(side.sum())
            if least <= n <= len(y) - least:
                gain = n * (y[side].mean() - y.mean()) ** 2 + (len(y) - n) * (y[~side].mean() - y.mean()) ** 2
                if best is None or gain > best[0]:
                    best = gain, k, value, side
    if best is None:
        return []
    _, k, value, side = best
    out = []
    for above, part in ((True, side), (False, ~side)):
        rule = (*path, (k, above, value))
        out += [rule, *grow(x[part], y[part], depth - 1, tried, least, cuts, rule)]
    return out


@dataclass
class RuleModel:
    names: list[str]
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def column(self) -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, above, value in rule:
                test = test & ((F.col(self.names[k]) > value) if above else (F.col(self.names[k]) <= value))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 0.005, steps: int = 600, seed: int = 5) -> RuleModel:
    if not len(y):
        return RuleModel(names, 0.0, [], [])
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), size=max(1, int(0.6 * len(y))), replace=False)
        tried = rng.choice(x.shape[1], size=max(1, round(0.6 * x.shape[1])), replace=False)
        rules.update(dict.fromkeys(grow(x[rows], y[rows], depth, tried, max(5, len(y) // 200), 24)))
    found = {}
    for rule in rules:  # rules that hold on the same rows are one
        mask = holds(rule, x)
        if 0 < mask.sum() < len(y):
            found.setdefault(mask.tobytes(), (rule, mask))
    kept = list(found.values())
    prior = (y.sum() + 1) / (len(y) + 2)
    if not kept:
        return RuleModel(names, float(np.log(prior / (1 - prior))), [], [])
    z = np.stack([m for _, m in kept], axis=1).astype(float)
    scale = np.maximum(z.std(axis=0), 0.05)
    z = z / scale
    step = 4 * len(y) / np.linalg.norm(np.hstack([z, np.ones((len(y), 1))]), 2) ** 2
    w, b = np.zeros(z.shape[1]), float(np.log(prior / (1 - prior)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        error = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - step * (z.T @ error) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    some = np.flatnonzero(w)
    return RuleModel(names, float(b), [kept[i][0] for i in some], [float(w[i] / scale[i]) for i in some])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> RuleModel:
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # Of several rows with one id the least text counts, so that reruns fit the same model.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    stats, names = statistics(chosen, [F.col("doc_id"), F.col("y")])
    rows = sorted(stats.collect(), key=lambda r: r["doc_id"])  # most_rows at most
    return fit(np.array([[r[c] for c in names] for r in rows]).reshape(-1, len(names)), np.array([r["y"] for r in rows]), names)


def scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    stats, _ = statistics(docs, [F.col("doc_id").alias("doc_id")])
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def quality_scores(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    return scores(docs, train(docs, labels, most_rows))
