"""From prompts to packed context: candidates over all channels, their features at a cut-off, ranking, bundles and budgets.

Tables, for many tasks at once:
    tasks     task_id, prompt
    evidence  task_id, kind (one of EVIDENCE), path, function, and its texts: title, body, trace, message
    seeds     task_id, unit_id: units that a task is known to be about
    dirty     task_id, path: files with changes that aren't committed
    units     unit_id, path, title, content, kind, tokens, and name, qualified_name, unsafe, is_exported where they are known
    edges     src, dst, kind, between unit_ids
    commits   sha, ts, file: paths that commits touch

Channels read whole tables; from the top candidates of each task on (`most` of them), everything is keyed by (task_id, unit_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lexical_tokens, token_estimate
from tessera.operators.graph import degrees, distances, neighbourhood
from tessera.operators.lexical import LexicalIndex, query_terms
from tessera.operators.history import change_frequency, co_change_scores, directional_co_change, until
from tessera.operators.packing import compose_bundles, fit_rendered, least_useful, resolution_curve, solve_budget
from tessera.operators.ranking import heuristic_score, rank_score, ranked
from tessera.operators.retrieval import containing, exact_matches, frame_matches, fuse, fusion_score, overlap_ratio, top_per
from tessera.storage import new_folder, settled

#: Kinds of evidence, and the feature that says that a unit's path is in it.
EVIDENCE = {"STACK_TRACE": "in_stack_trace", "TEST_FAILURE": "is_failing_test_target", "COMPILER_ERROR": "in_compiler_error"}
KEY = ["task_id", "unit_id"]


def _full(units: DataFrame) -> DataFrame:
    types = {"name": "string", "qualified_name": "string", "unsafe": "boolean", "is_exported": "boolean"}
    return units.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in units.columns})


def channels(tasks: DataFrame, evidence: DataFrame, units: DataFrame, edges: DataFrame, commits: DataFrame, cutoff: str, hops: int = 2, lexical: int = 100, index: LexicalIndex | None = None) -> list[DataFrame]:
    """The five channels of candidates: exact, lexical, stack_trace, and from their hits graph and (from all of these) git_co_change.

    index: of the units, where there is one already.
    """
    units = _full(units)
    if index is None:
        index = LexicalIndex.build(units, new_folder(units.sparkSession, "lexical-index"))
    terms = settled(query_terms(tasks, evidence), "terms")
    exact = exact_matches(tasks, units, evidence).select(*KEY, F.lit("exact").alias("source"), F.lit(True).alias("exact_match"))
    words = index.top(terms, lexical).select(*KEY, F.lit("lexical").alias("source"), "lexical_score")
    frames = evidence.filter(F.col("kind").isin("STACK_TRACE", "TEST_FAILURE")).select("task_id", F.col("path").alias("file"), "function")
    runtime = frame_matches(frames, units).select(*KEY, F.lit("stack_trace").alias("source"), F.lit(True).alias("runtime_match"))
    direct = [settled(x, "channel") for x in (exact, words, runtime)]
    seeds = settled(reduce(DataFrame.unionByName, [x.select(*KEY) for x in direct]).distinct(), "seeds")
    # A unit's neighbourhood is found once, however many tasks have it as a seed.
    around = neighbourhood(seeds.select(F.col("unit_id").alias("root")).distinct(), edges, hops)
    tests = F.array_contains(F.split("path", ">"), "TESTS")
    graph = seeds.withColumnRenamed("unit_id", "root").join(around, "root").groupBy("task_id", F.col("node").alias("unit_id")).agg(F.min("distance").alias("graph_distance"), F.bool_or(tests).alias("test_relationship"))
    graph = settled(graph.withColumn("source", F.lit("graph")), "channel")
    held = seeds.unionByName(graph.select(*KEY)).distinct()
    paths = units.select("unit_id", F.lower("path").alias("file")).filter("file is not null")
    scores = co_change_scores(commits.withColumn("file", F.lower("file")), cutoff)
    partners = held.join(paths, "unit_id").join(scores.select("file", "other", "score"), "file").groupBy("task_id", "other").agg(F.max("score").alias("co_change_score"))
    change = partners.join(paths.withColumnRenamed("file", "other"), "other").select(*KEY, F.lit("git_co_change").alias("source"), "co_change_score")
    return [*direct, graph, change]


def candidates(tasks: DataFrame, evidence: DataFrame, units: DataFrame, edges: DataFrame, commits: DataFrame, cutoff: str, most: int = 50, hops: int = 2, index: LexicalIndex | None = None) -> DataFrame:
    """The fused candidates of each task (fuse's columns), with fusion_score and place: the best `most`, ties by unit."""
    rows = fuse(channels(tasks, evidence, units, edges, commits, cutoff, hops, index=index)).withColumn("fusion_score", F.round(fusion_score(), 6))
    return top_per(rows, "task_id", "fusion_score", "unit_id", most, "place")


def _said(text: str, what: Column) -> Column:
    return F.coalesce((what != "") & F.contains(F.lower(text), F.lower(what)), F.lit(False))


def build_features(chosen: DataFrame, tasks: DataFrame, evidence: DataFrame, seeds: DataFrame, dirty: DataFrame, units: DataFrame, edges: DataFrame, commits: DataFrame, cutoff: str, days: int = 30) -> DataFrame:
    """The feature row of each candidate (chosen: what candidates gives), as of the cut-off: static, lexical, graph, runtime and history."""
    units = _full(units)
    rows = chosen.select(*KEY, "exact_match", "lexical_score", "sources").join(tasks.select("task_id", "prompt", lexical_tokens(F.col("prompt")).alias("query")), "task_id").join(units, "unit_id")
    text = F.concat_ws(" ", "path", F.col("unit_id").cast("string"), "qualified_name", "content", "title")
    # The words that prompt and unit share are settled first: within the ratio they would be found anew for each word of the prompt.
    rows = rows.withColumn("shared", F.array_intersect("query", lexical_tokens(text))).withColumn("tokens", token_estimate(F.col("tokens"), F.col("content"))).drop("content")
    rows = settled(rows, "shared-words")
    overlap = overlap_ratio(F.col("query"), F.col("shared"))
    low, kind = F.lower(F.coalesce("path", F.lit(""))), F.col("kind")
    rows = rows.select(
        *KEY, "kind", "path", "sources", F.coalesce("unsafe", F.lit(False)).alias("unsafe"),
        "tokens",
        ((kind == "TEST") | low.contains("test")).alias("is_test"), (kind == "CONFIG").alias("is_config"), (kind == "DOCUMENTATION").alias("is_documentation"), kind.isin("SCHEMA", "MIGRATION").alias("is_schema"), F.coalesce("is_exported", F.lit(False)).alias("is_exported"),
        (F.col("exact_match") | F.array_contains("sources", "exact") | _said("prompt", F.col("name")) | _said("prompt", F.col("title"))).alias("exact_symbol_match"),
        _said("prompt", F.col("path")).alias("exact_path_match"), "lexical_score", overlap.alias("token_overlap_ratio"),
    )
    rows = settled(rows.withColumn("lexical_score", F.coalesce("lexical_score", F.col("token_overlap_ratio") * 10)), "unit-features")
    own = rows.select(*KEY, "path")

    # Graph: what the seeds and the error frames reach, by way of the edges.
    near = distances(seeds.select("unit_id").distinct().withColumnRenamed("unit_id", "root"), edges).withColumnsRenamed({"root": "seed", "node": "unit_id"})
    by_seed = own.select(*KEY).join(seeds.select("task_id", F.col("unit_id").alias("seed")).distinct(), "task_id").join(near, ["seed", "unit_id"])
    links = edges.select(F.col("src").alias("unit_id"), F.col("dst").alias("seed"), F.lit(True).alias("back")).distinct()
    by_seed = by_seed.join(links, ["unit_id", "seed"], "left").groupBy(*KEY).agg(
        F.min("distance").alias("min_distance_to_seed"), F.bool_or((F.col("distance") == 1) & F.coalesce("back", F.lit(False))).alias("is_direct_dependency"), F.bool_or(F.col("distance") == 1).alias("is_direct_dependent"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("unit_id")).distinct()
    degree = degrees(edges).withColumnsRenamed({"node": "unit_id", "degree": "graph_degree"})
    errors = evidence.select("task_id", F.col("path").alias("error")).filter("error <> ''").distinct()
    placed = units.select("unit_id", "path").filter("path <> ''").join(nodes, "unit_id", "left_semi")
    at_error = containing(placed, errors.select("error").distinct(), "path", "error", either=True).join(errors, "error").select("task_id", F.col("unit_id").alias("root")).distinct()
    reach = distances(at_error.select(F.col("task_id").alias("root"), F.col("root").alias("node")).distinct(), edges)  # from all of a task's frames at once
    by_error = reach.select(F.col("root").alias("task_id"), F.col("node").alias("unit_id"), F.col("distance").alias("min_distance_to_error_frame")).join(own.select(*KEY), KEY, "left_semi")

    # Evidence and uncommitted changes: paths within paths.
    places = own.select("path").filter("path <> ''").distinct()
    stated = containing(evidence.select(F.col("path").alias("error")).distinct(), places, "error", "path").join(evidence.select("task_id", "kind", F.col("path").alias("error")), "error")
    shown = stated.groupBy("task_id", "path").agg(*[F.bool_or(F.col("kind") == k).alias(c) for k, c in EVIDENCE.items()])
    changed = containing(places, dirty.select(F.col("path").alias("dirty")).distinct(), "path", "dirty", either=True).join(dirty.select("task_id", F.col("path").alias("dirty")), "dirty").select("task_id", "path", F.lit(True).alias("in_dirty_diff")).distinct()

    # History up to the cut-off.
    often = change_frequency(commits, cutoff, days).withColumnRenamed("file", "path")
    seed_paths = seeds.join(units.select("unit_id", "path"), "unit_id").select("task_id", F.col("path").alias("a")).filter("a is not null").distinct()
    pairs = own.filter("path is not null").select("task_id", F.col("path").alias("b")).distinct().join(seed_paths, "task_id").filter("a <> b")
    together = directional_co_change(until(commits, cutoff), pairs.select("a", "b").distinct(), cutoff)
    change = pairs.join(together, ["a", "b"]).groupBy("task_id", F.col("b").alias("path")).agg(F.max("score").alias("max_co_change"))

    out = rows.join(degree, "unit_id", "left").join(by_seed, KEY, "left").join(by_error, KEY, "left").join(shown, ["task_id", "path"], "left").join(changed, ["task_id", "path"], "left").join(often, "path", "left").join(change, ["task_id", "path"], "left")
    flags = ["is_direct_dependency", "is_direct_dependent", *EVIDENCE.values(), "in_dirty_diff"]
    numbers = {"graph_degree": "int", "changes": "int", "recent_changes": "int", "max_co_change": "double"}
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(F.col(c), F.lit(0)).cast(t) for c, t in numbers.items()})
    out = out.withColumns({f"from_{c}": F.array_contains("sources", s) for c, s in {"exact": "exact", "lexical": "lexical", "graph": "graph", "history": "git_co_change", "runtime": "stack_trace"}.items()})
    judged = {"has_judgment": F.lit(False)} | {c: F.lit(None).cast("double") for c in ("semantic", "implementation", "edit_target", "root_cause", "confidence")}
    return settled(out.withColumns(judged).withColumn("heuristic_score", heuristic_score()), "features")


def rank_features(rows: DataFrame) -> DataFrame:
    """Feature rows with score, reasons and rank; ties by unit."""
    score, reasons = rank_score()
    return ranked(rows.withColumn("reasons", reasons).withColumn("score", score), "task_id", "score", "unit_id")


def pack(rows: DataFrame, edges: DataFrame, evidence: DataFrame, limit: int = 16_000, max_units: int = 25, max_cost: float | None = None) -> DataFrame:
    """task_id, unit_id, place, gain, resolution, token_cost and overflow of what is packed for each task from its ranked feature rows:
    bundles by resolution curves, the budget's resolutions, and the last gate."""
    rows = rows.withColumnsRenamed({"min_distance_to_seed": "distance"}).withColumn("is_direct", F.col("is_direct_dependency") | F.col("is_direct_dependent"))
    keyed = rows.withColumn("least", least_useful()).withColumn("both", F.struct(*KEY))
    curve = resolution_curve(keyed.withColumn("unit_id", F.col("both")), F.col("score")).select("unit_id.*", "resolution", "allowed", "token_cost", "utility")
    # The cheapest resolution that is allowed and of use, of equally cheap ones the least.
    option = curve.join(keyed.select(*KEY, "least"), KEY).filter("allowed and resolution >= least").groupBy(*KEY).agg(F.min_by(F.struct("token_cost", "utility"), F.struct("token_cost", "resolution")).alias("o"))
    priced = rows.join(option, KEY).select("task_id", "unit_id", "rank", "score", F.col("o.token_cost").alias("tokens"), "path", (F.col("o.utility") * 5).alias("bonus"))
    inside = rows.select("task_id", F.col("unit_id").alias("src")).join(edges.select("src", "dst").distinct(), "src")
    links = inside.join(rows.select("task_id", F.col("unit_id").alias("dst")), ["task_id", "dst"]).select("task_id", "src", "dst")
    bundle = settled(compose_bundles(priced, links, evidence.select("task_id", "path").filter("path <> ''"), max_units, limit), "bundles")
    solved = settled(solve_budget(bundle.select(*KEY, "place").join(rows, KEY), limit, max_cost), "budget")
    plan = bundle.join(solved, KEY).join(keyed.select(*KEY, "tokens", "least", "unsafe", "in_stack_trace", "in_dirty_diff"), KEY)
    gate = fit_rendered(plan.select(*KEY, "place", "tokens", "resolution", "least", (F.col("in_stack_trace") | F.col("in_dirty_diff")).alias("mandatory"), (~F.col("unsafe")).alias("safe")), limit)
    return bundle.join(gate, KEY).join(solved.select(*KEY, "token_cost", F.col("resolution").alias("solved")), KEY).select(*KEY, "place", "gain", F.col("solved").alias("solved_resolution"), "token_cost", "resolution", "overflow")

