"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each text gives a vector of transformed statistics: mean word length, and square roots of symbols, upper-case letters and repeated
words by size. For each (language, source) the minimum-covariance-determinant estimate is sought: of all sets with the share `subset` of the rows
the one whose covariance has the least determinant. From each of several starts (medians and median deviations; all rows; `draws` small
draws by hash) concentration steps are taken, each of which gives the next mean and covariance by the rows nearest to the last one,
until the determinant stops falling; the start that ends with the least determinant counts. Distances are rescaled so that their
median is that of the chi-square distribution; a text beyond `cutoff` is rejected. Groups with fewer than `least_rows` texts use their
language's estimate, and that of all texts where the language has too few.

Estimates are made on a grid (`UNITS`): a group's texts are counted by cell once, and all steps work on cells and counts, in whole
numbers. So a step's cost doesn't grow with the number of texts, and no order of rows changes an estimate. Texts are judged by
their exact statistics. A variance floor for each statistic (a difference that never matters) is added to the covariance, as a fixed target of
a regularised determinant; concentration steps lower that determinant too. It keeps estimates defined where a statistic hardly varies.

Null text counts as empty. Texts of under 50 words, or with over half of their words in repeated windows, fail the base rule and are
neither judged by nor used for the estimates. Null lang and source are groups of their own. Repeated rows are judged one by one.
An empty table gives no rows; other columns of the input are ignored (or carried by `accepted`), whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import sent, written
from tessera.llm.textstats import base_statistics

#: Statistics of the vector, and the floor of each one's standard deviation. Most texts have no symbols and no repeats, so that the
#: closest rows don't vary in these and the floor stands for their spread.
FLOORS = {"f_length": 0.25, "f_symbols": 0.05, "f_upper": 0.01, "f_repeat": 0.1}
#: Width of a cell of the grid, and the most cells from zero (farther ones count as the last).
UNITS = {"f_length": 0.05, "f_symbols": 0.01, "f_upper": 0.005, "f_repeat": 0.02}
FARTHEST = 100_000_000
#: Median of the chi-square distribution with four degrees of freedom.
CHI2_4_MEDIAN = 3.356694
#: Its 0.9999 quantile: texts have heavier tails than normal vectors, and a clean one that goes is a loss.
CHI2_4_CUTOFF = 23.51
DIMENSIONS = list(FLOORS)
P = len(DIMENSIONS)
CELL = [f"q_{i}" for i in range(P)]
#: Least rows for an estimate of a group's own: ten a statistic.
LEAST_ROWS = 40
#: Starts by hash, and cells in each.
DRAWS = 6
DRAWN = 10
#: Concentration steps between two looks at the determinants: one plan each time.
STEPS = 4
#: A determinant's logarithm that falls by less than this has stopped falling.
STOPPED = 1e-9


def base_rules(docs: DataFrame, keep: list[Column]) -> DataFrame:
    stats = base_statistics(docs, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


def _vector(df: DataFrame) -> DataFrame:
    n, chars = F.col("n_words"), F.col("word_chars")
    ok = ~F.col("base_failed")
    return df.withColumns(
        {
            "f_length": F.when(ok, chars / n),
            "f_symbols": F.when(ok, F.sqrt(F.col("n_symbols") / chars)),
            "f_upper": F.when(ok, F.sqrt(F.col("n_upper") / chars)),
            "f_repeat": F.when(ok, F.sqrt(F.col("n_repeat_words") / n)),
        }
    )


def _names() -> list[str]:
    return [f"m_{i}" for i in range(P)] + [f"l_{i}_{j}" for i in range(P) for j in range(i + 1)] + ["logdet"]


def _factor(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the floored covariance c_i_j, and the logarithm of its determinant."""
    steps = []
    for j in range(P):
        for i in range(j, P):
            rest = f"c_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            floor = FLOORS[DIMENSIONS[i]] ** 2
            steps.append(f"sqrt(greatest({rest} + {floor!r}D, {floor!r}D)) AS l_{i}_{i}" if i == j else f"({rest}) / l_{j}_{j} AS l_{i}_{j}")
    return params.selectExpr("*", *steps, " + ".join(f"2 * ln(l_{i}_{i})" for i in range(P)) + " AS logdet")


def _with_distance(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Adds the squared Mahalanobis distance, by forward substitution; each step is a column of its own, so none is computed twice."""
    steps = [f"({v} - m_{i}" + "".join(f" - l_{i}_{k} * _y{k}" for k in range(i)) + f") / l_{i}_{i} AS _y{i}" for i, v in enumerate(values)]
    return df.selectExpr("*", *steps, " + ".join(f"_y{i} * _y{i}" for i in range(P)) + f" AS {name}").drop(*[f"_y{i}" for i in range(P)])


def _cell_values() -> list[str]:
    return [f"{q} * {UNITS[d]!r}D" for q, d in zip(CELL, DIMENSIONS, strict=True)]


def _moments(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """keys, more, mean m_i and covariance c_i_j of the cells of rows, `w` times each: exact sums of whole numbers, the same in any order."""
    w = F.col("w").cast("decimal(18,0)")
    sums = [F.sum(w * F.col(q).cast("decimal(18,0)")).alias(f"s_{i}") for i, q in enumerate(CELL)]
    sums += [F.sum(w * (F.col(CELL[i]) * F.col(CELL[j])).cast("decimal(18,0)")).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*more, F.sum("w").cast("double").alias("w"), *sums)
    held, unit = out.columns[: len(keys) + len(more)], [UNITS[d] for d in DIMENSIONS]
    means = [f"CAST(s_{i} AS DOUBLE) / w AS u_{i}" for i in range(P)]
    cov = [f"(CAST(s_{i}_{j} AS DOUBLE) / w - u_{i} * u_{j}) * {unit[i] * unit[j]!r}D AS c_{i}_{j}" for i in range(P) for j in range(i + 1)]
    return out.selectExpr(*[f"`{k}`" for k in held], *means, *[f"u_{i} * {unit[i]!r}D AS m_{i}" for i in range(P)], *cov).drop(*[f"u_{i}" for i in range(P)])


def _lower_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the least value up to which half of the weight n lies. rows: keys, value, n; a row a value."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return rows.withColumn("enough", 2 * upto >= whole).filter("enough").groupBy(*keys).agg(F.min(value).alias("middle"))


def starts(cells: DataFrame, draws: int = DRAWS) -> DataFrame:
    """group, start and the parameters that the steps begin with. cells: group, the cell and its count n."""
    sides = cells.select("group", "n", F.posexplode(F.array(*CELL)).alias("side", "value"))
    middles = _lower_median(sides.groupBy("group", "side", "value").agg(F.sum("n").alias("n")), ["group", "side"], "value")
    middles = written(middles, "medians")
    off = sides.join(sent(middles), ["group", "side"]).groupBy("group", "side", F.abs(F.col("value") - F.col("middle")).alias("value")).agg(F.sum("n").alias("n"))
    spread = _lower_median(off, ["group", "side"], "value").withColumnRenamed("middle", "off").join(middles, ["group", "side"])
    pick = lambda c, i: F.max(F.when(F.col("side") == i, F.col(c)))
    robust = spread.groupBy("group").agg(*[(pick("middle", i) * UNITS[d]).alias(f"m_{i}") for i, d in enumerate(DIMENSIONS)], *[((1.4826 * UNITS[d] * pick("off", i)) ** 2).alias(f"c_{i}_{i}") for i, d in enumerate(DIMENSIONS)])
    robust = robust.withColumns({f"c_{i}_{j}": F.lit(0.0) for i in range(P) for j in range(i)}).withColumn("start", F.lit(0))
    # Cells are drawn in proportion to their counts: the least of exponential variates at these rates come first.
    tried = cells.withColumn("start", F.explode(F.array(*[F.lit(2 + k) for k in range(draws)]))) if draws else cells.withColumn("start", F.lit(2)).filter("false")
    even = (F.pmod(F.xxhash64("start", *CELL), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    place = F.row_number().over(Window.partitionBy("group", "start").orderBy("race", *CELL))
    drawn = tried.withColumn("race", -F.log(even) / F.col("n")).withColumn("place", place).filter(F.col("place") <= DRAWN).select("group", "start", *CELL, F.lit(1).cast("long").alias("w"))
    some = drawn.unionByName(cells.select("group", F.lit(1).alias("start"), *CELL, F.col("n").alias("w")))
    columns = ["group", "start", *[f"m_{i}" for i in range(P)], *[f"c_{i}_{j}" for i in range(P) for j in range(i + 1)]]
    first = robust.select(*columns).unionByName(_moments(some, ["group", "start"]).select(*columns))
    # The determinant of a start is no subset's: the first step counts as a fall.
    return written(_factor(first).withColumn("logdet", F.lit(float("inf"))).select("group", "start", *_names()), "starts")


def estimates(cells: DataFrame, subset: float = 0.75, draws: int = DRAWS) -> DataFrame:
    """For each group: mean m_i, factor l_i_j, logdet and the scale of its squared distances. cells (written): group, the cell, n and rows
    (of the group)."""
    now, done = starts(cells, draws), []
    while True:
        after = now
        for _ in range(STEPS):
            at = _with_distance(cells.join(sent(now) if after is now else after, "group"), "d2", _cell_values())
            order = Window.partitionBy("group", "start").orderBy("d2", *CELL)
            share = F.ceil(F.col("rows") * subset) - (F.sum("n").over(order) - F.col("n"))
            near = at.withColumn("w", F.least(F.col("n"), share)).filter("w > 0")
            after = _factor(_moments(near, ["group", "start"], F.first("logdet").alias("before"))).select("group", "start", "before", *_names())
        after = written(after.withColumn("falls", F.col("logdet") < F.col("before") - STOPPED), "estimate")
        done.append(after.filter("not falls").drop("before", "falls"))
        now = after.filter("falls").drop("before", "falls")
        if now.isEmpty():
            break
    ended = functools.reduce(DataFrame.unionByName, done)
    best = written(ended.groupBy("group").agg(F.min_by(F.struct(*_names()), F.struct("logdet", "start")).alias("x")).select("group", "x.*"), "least-determinants")
    at = _with_distance(cells.join(sent(best), "group"), "d2", _cell_values()).groupBy("group", "d2").agg(F.sum("n").alias("n"))
    scale = F.greatest(F.lit(1.0), F.col("middle") / CHI2_4_MEDIAN).alias("scale")
    return written(best.join(_lower_median(at, ["group"], "d2").select("group", scale), "group"), "estimates")


def _levels() -> list[Column]:
    """Names of a text's groups, the finest first."""
    return [F.to_json(F.struct(F.lit(2).alias("level"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("level"), "lang")), F.lit('{"level":0}')]


def fitted(table: DataFrame, least_rows: int = LEAST_ROWS, subset: float = 0.75, draws: int = DRAWS) -> DataFrame:
    """kind (finest group) and the estimate that its texts are judged by. table: lang, source, base_failed and the vector."""
    levels = _levels()
    judged = table.filter(~F.col("base_failed"))
    grid = [F.least(F.round(F.col(d) / UNITS[d]), F.lit(float(FARTHEST))).cast("long").alias(q) for d, q in zip(DIMENSIONS, CELL, strict=True)]
    cells = written(judged.select("lang", "source", *grid).groupBy("lang", "source", *CELL).agg(F.count(F.lit(1)).alias("n")), "cells")
    kinds = cells.groupBy("lang", "source").agg(F.sum("n").alias("n2")).withColumns({f"g{k}": c for k, c in enumerate(levels)})
    kinds = kinds.join(cells.groupBy(levels[1].alias("g1")).agg(F.sum("n").alias("n1")), "g1")
    chosen = F.when(F.col("n2") >= least_rows, F.col("g0")).when(F.col("n1") >= least_rows, F.col("g1")).otherwise(F.col("g2"))
    kinds = written(kinds.select(F.col("g0").alias("kind"), chosen.alias("group")), "kinds")
    # A language's estimate, or that of all, is made of all its texts, and only if some group asks for it.
    wanted = written(kinds.select("group").distinct(), "groups")
    own = cells.select(F.explode(F.array(*levels)).alias("group"), *CELL, "n").join(sent(wanted), "group").groupBy("group", *CELL).agg(F.sum("n").alias("n"))
    sizes = own.groupBy("group").agg(F.sum("n").alias("rows"))
    params = estimates(written(own.join(sizes, "group"), "group-cells"), subset, draws)
    return written(kinds.join(params, "group"), "kinds")


def _judged(rows: DataFrame, kinds: DataFrame, cutoff: float) -> DataFrame:
    rows = rows.withColumn("kind", _levels()[0]).join(sent(kinds), "kind", "left")
    rows = _with_distance(rows, "_d2", DIMENSIONS).withColumn("distance", F.when(~F.col("base_failed"), F.col("_d2") / F.col("scale")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))


def _keep() -> list[Column]:
    return [F.col(c).alias(c) for c in ("doc_id", "lang", "source")]


def quality_verdicts(docs: DataFrame, cutoff: float = CHI2_4_CUTOFF, least_rows: int = LEAST_ROWS, subset: float = 0.75, draws: int = DRAWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for each row of docs."""
    table = written(_vector(base_rules(docs, _keep())), "statistics")
    rows = _judged(table, fitted(table, least_rows, subset, draws), cutoff)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def accepted(docs: DataFrame, cutoff: float = CHI2_4_CUTOFF, least_rows: int = LEAST_ROWS, subset: float = 0.75, draws: int = DRAWS) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows are named by two hashes of id, text, language and source."""
    whole = ["doc_id", "text", "lang", "source"]
    names = [F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2")]
    table = written(_vector(base_rules(docs, [*_keep(), *names])), "statistics")
    rows = _judged(table, fitted(table, least_rows, subset, draws), cutoff)
    gone = written(rows.filter(~F.col("kept")).select("k1", "k2").distinct(), "rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)
    return rows.join(sent(gone), ["k1", "k2"], "left_anti").select("row.*")
