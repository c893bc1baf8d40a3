"""Graph operators over edges (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import settled


#: Values of one side in a block of pairs_by_block, and those of the first side that generated code pairs with a whole block before it hands the pairs on: it holds
#: copies of these in memory, so they are few enough for a core's cache.
BLOCK = 1024
CUT = 32


def _blocks(df: DataFrame, key: list[str], value: str, block: int) -> DataFrame:
    """key, and lists of about `block` values each."""
    n = df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    dealt = df.join(n, key).withColumn("_cell", F.when(F.col("_n") > 1, F.pmod(F.xxhash64(value), F.col("_n"))).otherwise(F.lit(0).cast("long")))
    return dealt.groupBy(*key, "_cell").agg(F.collect_list(value).alias(value)).drop("_cell")


def met_blocks(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, block: int = BLOCK) -> DataFrame:
    """key, and lists a and b: each block of left with each block of right of the same key."""
    return _blocks(left, key, a, block).join(_blocks(right, key, b, block), key)


def paired(met: DataFrame, a: str, b: str) -> DataFrame:
    """Each value of a list a with each of the list b beside it, the other columns as they are; lists are dealt over all tasks before."""
    key = [c for c in met.columns if c not in (a, b)]
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, F.xxhash64(F.col(a)[0]), F.xxhash64(F.col(b)[0]))
    cut = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(CUT)), lambda i: F.slice(a, i + 1, F.lit(CUT)))
    return met.select(*key, b, F.explode(cut).alias(a)).select(*key, b, F.explode(a).alias(a)).select(*key, a, F.explode(b).alias(b))


def pairs_by_block(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, block: int = BLOCK) -> DataFrame:
    """key, a, b: the join of left and right (key columns without nulls; a and b hold the others, without nulls) where keys have so many rows that their pairs are far
    more than all rows. Sides are gathered into blocks, which meet and are dealt over all tasks before pairs are made: what is shuffled grows
    with the rows and with pairs by the square of a block, and no key is one task's work. Pairs are not written.
    """
    return paired(met_blocks(left, right, key, a, b, block), a, b)


def first_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each (src, dst, kind): the first in order."""
    w = Window.partitionBy("src", "dst", "kind").orderBy(order)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def adjacent(edges: DataFrame, nodes: DataFrame, kinds: list[str] = (), direction: str = "out") -> DataFrame:
    """Edges that leave (out), reach (in) or touch (both) the given nodes (node); no kinds means all."""
    if kinds:
        edges = edges.filter(F.col("kind").isin(list(kinds)))
    out = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    into = edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into).distinct()


def distances(seeds: DataFrame, edges: DataFrame, hops: int = 5, directed: bool = True) -> DataFrame:
    """root, node, distance: the fewest hops (at most `hops`) from each root to each node, roots themselves at 0.

    Each round joins only the frontier with the edges and keeps nodes not seen before, so a node is expanded once for each root.
    """
    step = edges.select("src", "dst")
    if not directed:
        step = step.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = settled(step.distinct(), "steps")
    node = F.col("node") if "node" in seeds.columns else F.col("root").alias("node")
    frontier = seen = settled(seeds.select("root", node, F.lit(0).alias("distance")), "roots")
    for hop in range(1, hops + 1):
        reached = frontier.select("root", F.col("node").alias("src")).join(step, "src").select("root", F.col("dst").alias("node")).distinct()
        frontier = settled(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """root, node, distance, path of kinds: nodes within hops, either direction; of several shortest paths the least one.

    Roots whose nodes and paths at the first hop are the same, themselves aside, are one class: further hops are made once for a class, and all its nodes meet
    its roots at the end, in one stage, by blocks and unwritten, however many pairs that makes. Edges are neither sorted nor shuffled as a whole: equal ones
    fall together where the least path is taken.
    """
    roots = starts.select("root").distinct()
    edges = edges.select("src", "dst", "kind")
    if hops > 1:
        edges = settled(edges, "edges")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    first = roots.withColumnRenamed("root", "src").join(both, "src").filter("src <> dst").groupBy(F.col("src").alias("root"), F.col("dst").alias("node")).agg(F.min("kind").alias("path"))
    if hops == 1:
        return first.select("root", "node", F.lit(1).alias("distance"), "path")
    first = settled(first, "frontier")
    # A class is told by a hash of its set of nodes and paths; two long sums, and not the set, meet in the shuffle.
    told = F.struct(F.sum(F.xxhash64("node", "path").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("path", "node", F.lit(1)).cast("decimal(38,0)")).alias("b"), F.count(F.lit(1)).alias("n"))
    members = settled(first.groupBy("root").agg(told.alias("told")).withColumn("class", F.sha2(F.to_json("told"), 256)).select("class", "root"), "classes")
    some = members.groupBy("class").agg(F.min("root").alias("root"))
    frontier = settled(some.join(first, "root").select("class", "node", F.lit(1).alias("distance"), "path"), "class-frontier")
    seen = frontier
    for hop in range(2, hops + 1):
        reached = frontier.select("class", F.col("node").alias("src"), "path").join(both, "src").groupBy("class", F.col("dst").alias("node")).agg(F.min(F.concat_ws(">", "path", "kind")).alias("path"))
        frontier = settled(reached.join(seen.select("class", "node"), ["class", "node"], "left_anti").select("class", "node", F.lit(hop).alias("distance"), "path"), "class-frontier")
        seen = seen.unionByName(frontier)
    pairs = pairs_by_block(members, seen.select("class", F.struct("node", "distance", "path").alias("at")), ["class"], "root", "at")
    return pairs.select("root", "at.node", "at.distance", "at.path").filter("root <> node")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def contained(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges file -CONTAINS-> symbol and back, by path. files: file_id, path; symbols: symbol_id, path."""
    pairs = files.join(symbols, "path").select("file_id", "symbol_id")
    forth = pairs.select(F.col("file_id").alias("src"), F.col("symbol_id").alias("dst"), F.lit("CONTAINS").alias("kind"))
    return forth.unionAll(pairs.select("symbol_id", "file_id", F.lit("DECLARED_IN")))


def test_base(path: Column) -> Column:
    """The name that a test file is for: its last part without .test or .spec and the extension; null for other files."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.rlike(r"\.(test|spec)\.[a-z]+$"), F.regexp_replace(last, r"\.(test|spec)\.[a-z]+$", ""))


def tests_of(files: DataFrame) -> DataFrame:
    """Edges test -TESTS-> implementation of the same base name. files: file_id, path."""
    tests = files.select("file_id", test_base(F.col("path")).alias("base")).filter("base is not null")
    last = F.element_at(F.split("path", "/"), -1)
    code = files.filter(test_base(F.col("path")).isNull()).select(F.col("file_id").alias("dst"), F.regexp_replace(last, r"\.[a-z]+$", "").alias("base"))
    return tests.join(code, "base").select(F.col("file_id").alias("src"), "dst", F.lit("TESTS").alias("kind"))


def configured(configs: DataFrame, files: DataFrame) -> DataFrame:
    """Edges config -CONFIGURES-> file whose path begins with the config's directory, letter by letter (all files for one at the top), not itself.

    An equi-join on the beginnings of paths, at the lengths that directories have; no prefix scan.
    """
    own = configs.select("config_id", F.col("path").alias("config_path"), F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("dir"))
    lengths = own.agg(F.collect_set(F.length("dir")).alias("lengths"))
    fits = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.left(F.col("path"), n))
    below = files.crossJoin(F.broadcast(lengths)).select("file_id", "path", F.explode(fits).alias("dir"))
    pairs = pairs_by_block(own.select("dir", F.struct("config_id", "config_path").alias("c")), below.select("dir", F.struct("file_id", "path").alias("f")), ["dir"], "c", "f")
    return pairs.filter("f.path <> c.config_path").select(F.col("c.config_id").alias("src"), F.col("f.file_id").alias("dst"), F.lit("CONFIGURES").alias("kind"))


def normal_path(path: Column) -> Column:
    """A slash path with . and .. resolved."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(fold, "/")


def imports(statements: DataFrame, files: DataFrame) -> DataFrame:
    """Edges file -IMPORTS-> file: relative specifiers resolved against the importer, with or without extension.

    statements: file_id, path, specifier; files: file_id, path.
    """
    wanted = statements.select(F.col("file_id").alias("src"), normal_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("specifier"))).alias("target"))
    keys = files.select(F.col("file_id").alias("dst"), F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", r"\.[a-z]+$", "")))).alias("target"))
    return wanted.join(keys, "target").select("src", "dst", F.lit("IMPORTS").alias("kind")).distinct()


def enclosing(uses: DataFrame, spans: DataFrame) -> DataFrame:
    """The narrowest span around each use: uses (file, line, name), spans (file, symbol, start, end); ties by symbol."""
    inside = uses.join(spans, "file").filter(F.col("line").between(F.col("start"), F.col("end")))
    w = Window.partitionBy("file", "line", "name").orderBy(F.col("end") - F.col("start"), "symbol")
    return inside.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolve_calls(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """src symbol to dst symbols of the called name: those of the same class in the file, else of the file, else all; never itself.

    Each level hands on only the uses of which it knows no symbol, so a name that stands in every file meets all of its namesakes only where
    nothing nearer has it. Pairs are made last, by blocks of all levels in one stage, and neither written nor shuffled.
    uses: src, file, owner (null outside classes), name; symbols: dst, file, owner, name. A src is in one file and owner, a dst stands once.
    """
    left = settled(uses.select("src", "file", "owner", "name").distinct(), "uses")
    met = None
    for level, by in ((1, ["file", "owner", "name"]), (2, ["file", "name"]), (3, ["name"])):
        known = symbols.select(*by).distinct()
        blocks = met_blocks(left.join(known, by, "left_semi").select(*by, "src"), symbols.select(*by, "dst"), by, "src", "dst").select("name", F.lit(level).alias("level"), "src", "dst")
        met = blocks if met is None else met.unionByName(blocks)
        if level < 3:
            left = settled(left.join(known, by, "left_anti"), "unresolved")
    return paired(met, "src", "dst").filter("src <> dst").select("src", "dst", "name", "level")


#: Kinds of units that stand for files, and the confidence of each kind of edge.
FILE_KINDS = ["SOURCE_FILE", "TEST", "CONFIG", "MANIFEST"]
CONFIDENCE = {"CONTAINS": 1.0, "DECLARED_IN": 1.0, "TESTS": 0.95, "TESTS_SYMBOL": 0.9, "CONFIGURES": 0.8, "IMPORTS": 0.9, "HERITAGE": 0.85, "CALLS": 0.7, "TYPE_USES": 0.8, "REFERENCES": 0.7}


def build_graph(files: DataFrame, symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """src, dst, kind, confidence: the ten kinds of edges between files and symbols, each once, with its greatest confidence.

    files: file_id, path, kind; symbols: symbol_id, file_id, name, owner (the class it is in), start, end; uses: file_id, use, name, line, as
    sources.code.uses gives them. Ids of files and symbols are of one type and differ.
    """
    named = lambda kind, c: [F.lit(kind).alias("kind"), F.lit(CONFIDENCE[c]).alias("confidence")]
    files, symbols = settled(files.filter(F.col("kind").isin(FILE_KINDS)), "files"), settled(symbols, "symbols")
    own = symbols.join(files.select("file_id"), "file_id", "left_semi")
    out = [own.select(F.col("file_id").alias("src"), F.col("symbol_id").alias("dst"), *named("CONTAINS", "CONTAINS")), own.select(F.col("symbol_id").alias("src"), F.col("file_id").alias("dst"), *named("DECLARED_IN", "DECLARED_IN"))]
    last = F.element_at(F.split("path", "/"), -1)
    tests = files.filter("kind = 'TEST'").select(F.col("file_id").alias("src"), F.regexp_replace(last, r"\.(test|spec)\.[a-z]+$", "").alias("base"))
    code = files.filter("kind = 'SOURCE_FILE'").select(F.col("file_id").alias("dst"), F.regexp_replace(last, r"\.[a-z]+$", "").alias("base"))
    tested = settled(tests.join(code, "base").select("src", "dst"), "tested")
    out.append(tested.select("src", "dst", *named("TESTS", "TESTS")))
    out.append(tested.join(own.select(F.col("file_id").alias("dst"), "symbol_id"), "dst").select("src", F.col("symbol_id").alias("dst"), *named("TESTS", "TESTS_SYMBOL")))
    configs = files.filter(F.col("kind").isin("CONFIG", "MANIFEST")).select(F.col("file_id").alias("config_id"), "path")
    out.append(configured(configs, files).select("src", "dst", *named("CONFIGURES", "CONFIGURES")))

    placed = settled(uses.join(files.select("file_id", "path"), "file_id"), "placed-uses")
    statements = placed.filter("use = 'import' and name like '.%'").select("file_id", "path", F.col("name").alias("specifier"))
    out.append(imports(statements, files).select("src", "dst", *named("IMPORTS", "IMPORTS")))
    by_name = symbols.select(F.col("symbol_id").alias("dst"), "name")
    # A class's bases by name: what it extends or implements, which it uses as a type too.
    parts = F.split("name", " ")
    heritage = placed.filter(F.col("use").isin("extends", "implements")).select("file_id", "use", parts[0].alias("class"), parts[1].alias("name"))
    declared = own.groupBy("file_id", F.col("name").alias("class")).agg(F.min_by("symbol_id", "start").alias("symbol_id"))
    heritage = heritage.join(declared, ["file_id", "class"], "left").select(F.coalesce("symbol_id", "file_id").alias("src"), "use", "name").join(by_name, "name")
    kind = F.when(F.col("use") == "implements", "IMPLEMENTS").otherwise("INHERITS")
    out.append(heritage.select("src", "dst", F.explode(F.array(kind, F.lit("TYPE_USES"))).alias("kind"), F.lit(CONFIDENCE["HERITAGE"]).alias("confidence")))
    # The others go out from the narrowest symbol around them, else from the file.
    inner = placed.filter(F.col("use").isin("call", "type", "identifier")).join(symbols.select("name").distinct(), "name", "left_semi").select("file_id", "use", "name", "line").distinct()
    spans = own.select(F.col("file_id").alias("file"), F.col("symbol_id").alias("symbol"), "start", "end")
    around = enclosing(inner.select(F.col("file_id").alias("file"), "line", F.lit("").alias("name")).distinct(), spans).select(F.col("file").alias("file_id"), "line", "symbol")
    names = symbols.select(F.col("symbol_id").alias("symbol"), F.col("name").alias("own_name"), "owner")
    inner = settled(inner.join(around, ["file_id", "line"], "left").join(names, "symbol", "left").withColumn("src", F.coalesce("symbol", "file_id")), "inner-uses")
    calls = resolve_calls(inner.filter("use = 'call'").select("src", F.col("file_id").alias("file"), "owner", "name"), symbols.select(F.col("symbol_id").alias("dst"), F.col("file_id").alias("file"), "owner", "name"))
    out.append(calls.select("src", "dst", *named("CALLS", "CALLS")))
    out.append(inner.filter("use = 'type'").join(by_name, "name").filter("src <> dst").select("src", "dst", *named("TYPE_USES", "TYPE_USES")))
    out.append(inner.filter("use = 'identifier' and (own_name is null or name <> own_name)").join(by_name, "name").filter("src <> dst").select("src", "dst", *named("REFERENCES", "REFERENCES")))
    edges = out[0]
    for x in out[1:]:
        edges = edges.unionByName(x)
    return edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def chains(snapshots: DataFrame, hops: int) -> DataFrame:
    """snapshot_id, depth, ancestor: each snapshot's chain of parents, itself at 0; cycles end where they close."""
    step = snapshots.select(F.col("snapshot_id").alias("ancestor"), F.col("parent_id"))
    seen = snapshots.select("snapshot_id", F.lit(0).alias("depth"), F.col("snapshot_id").alias("ancestor"))
    frontier = seen
    for depth in range(1, hops + 1):
        up = frontier.join(step, "ancestor").filter("parent_id is not null").select("snapshot_id", F.lit(depth).alias("depth"), F.col("parent_id").alias("ancestor"))
        frontier = settled(up.join(seen.select("snapshot_id", "ancestor"), ["snapshot_id", "ancestor"], "left_anti").select("snapshot_id", "depth", "ancestor"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
