"""Queries of graphs; keys of the star schema stand for edges."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.ancestry import roots
from tessera.operators.graph import adjacent, build_graph, chains, configured, contained, degrees, distances, enclosing, first_edges, imports, neighbourhood, resolve_calls, tests_of
from tessera.operators.retrieval import containing
from tessera.registry import query
from tessera.sources.code import symbols, uses
from tessera.sources.tables import EDGES, UNITS, edges, table, units


def _roots(spark, folder):
    return table(spark, folder, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("root")).unionAll(table(spark, folder, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))))


_ROOTS = "(SELECT 'R' || r_regionkey AS root FROM region UNION ALL SELECT 'N' || n_nationkey FROM nation)"
_BFS = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {edges}), r(root, node, distance) AS (SELECT root, root, 0 FROM {roots}
  UNION SELECT r.root, e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < {hops})
  SELECT root, node, min(distance) AS distance FROM r GROUP BY root, node"""


@query(f"SELECT src, dst, kind FROM {EDGES} WHERE src IN (SELECT 'N' || n_nationkey FROM nation) AND kind IN ('CONTAINS')")
def g02_outgoing(spark, folder):
    nodes = table(spark, folder, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    return adjacent(edges(spark, folder), nodes, ["CONTAINS"])


@query(f"SELECT src, dst, kind FROM {EDGES} WHERE dst IN (SELECT 'N' || n_nationkey FROM nation)")
def g02_incoming(spark, folder):
    nodes = table(spark, folder, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    return adjacent(edges(spark, folder), nodes, direction="in").select("src", "dst", "kind")


@query(_BFS.format(edges=EDGES, roots=_ROOTS, hops=5))
def g03_shortest_distance(spark, folder):
    return distances(_roots(spark, folder), edges(spark, folder))


@query(f"""WITH sym AS (SELECT src, dst, kind FROM {EDGES} UNION SELECT dst, src, kind FROM {EDGES}),
  s AS (SELECT 'S' || s_suppkey AS root FROM supplier),
  one AS (SELECT root, dst AS node, min(kind) AS path FROM s JOIN sym ON src = root WHERE dst <> root GROUP BY ALL),
  two AS (SELECT root, dst AS node, min(path || '>' || kind) AS path FROM one JOIN sym ON src = node WHERE dst <> root AND (root, dst) NOT IN (SELECT (root, node) FROM one) GROUP BY ALL)
  SELECT root, node, 1 AS distance, path FROM one UNION ALL SELECT root, node, 2, path FROM two""")
def g04_neighbourhood(spark, folder):
    starts = table(spark, folder, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("root"))
    return neighbourhood(starts, edges(spark, folder), 2)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {EDGES}), r(root, node, distance) AS (
  SELECT n_regionkey, 'N' || n_nationkey, 0 FROM nation UNION SELECT r.root, e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 2)
  SELECT root AS task_id, node AS unit_id, min(distance) AS graph_distance FROM r GROUP BY ALL""")
def g05_seed_expansion(spark, folder):
    seeds = table(spark, folder, "nation").select(F.col("n_regionkey").alias("root"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    return distances(seeds, edges(spark, folder), 2).select(F.col("root").alias("task_id"), F.col("node").alias("unit_id"), F.col("distance").alias("graph_distance"))


@query(f"SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {EDGES} UNION ALL SELECT dst FROM {EDGES}) GROUP BY node")
def g06_degree(spark, folder):
    return degrees(edges(spark, folder))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {EDGES}), err AS (SELECT DISTINCT 'C' || c_custkey AS node FROM customer JOIN supplier ON contains(c_name, lpad(CAST(s_suppkey AS VARCHAR), 9, '0'))),
  r(node, distance) AS (SELECT node, 0 FROM err UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 5) SELECT node, min(distance) AS distance FROM r GROUP BY node""")
def g07_error_distance(spark, folder):
    paths = table(spark, folder, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("err"))
    nodes = containing(table(spark, folder, "customer"), paths, "c_name", "err")
    seeds = nodes.select(F.lit("err").alias("root"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node")).distinct()
    return distances(seeds, edges(spark, folder)).select("node", "distance")


@query(f"""WITH s AS (SELECT 'N' || n_nationkey AS seed FROM nation), near AS (SELECT DISTINCT seed, dst AS unit FROM s JOIN {EDGES} ON src = seed)
  SELECT unit, bool_or(unit IN (SELECT src FROM {EDGES} x WHERE x.dst = seed)) AS is_direct_dependency, bool_or(true) AS is_direct_dependent FROM near GROUP BY unit""")
def g08_direct_flags(spark, folder):
    e = edges(spark, folder)
    seeds = table(spark, folder, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("seed"))
    near = seeds.join(e, F.col("src") == F.col("seed")).select("seed", F.col("dst").alias("unit")).distinct()
    back = e.select(F.col("src").alias("unit"), F.col("dst").alias("seed"), F.lit(True).alias("back")).distinct()
    return near.join(back, ["seed", "unit"], "left").groupBy("unit").agg(F.bool_or(F.coalesce("back", F.lit(False))).alias("is_direct_dependency"), F.lit(True).alias("is_direct_dependent"))


@query("SELECT 'O' || o_orderkey AS src, 'L' || l_orderkey || '-' || l_linenumber AS dst, 'CONTAINS' AS kind FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'L' || l_orderkey || '-' || l_linenumber, 'O' || o_orderkey, 'DECLARED_IN' FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def j06_file_symbol_edges(spark, folder):
    files = table(spark, folder, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("file_id"), F.col("o_orderkey").alias("path"))
    symbols = table(spark, folder, "lineitem").select(F.concat_ws("-", F.concat(F.lit("L"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string")).alias("symbol_id"), F.col("l_orderkey").alias("path"))
    return contained(files, symbols)


_FILES = f"(SELECT unit_id AS file_id, CASE WHEN kind = 'TEST' THEN 'tests/doc_' || (unit_id // 4) || '.test.ts' ELSE 'src/doc_' || (unit_id // 4) || '.ts' END AS path FROM {UNITS})"


def _files(spark, folder):
    base = F.expr("cast(unit_id div 4 as string)")
    return units(spark, folder).select(F.col("unit_id").alias("file_id"), F.when(F.col("kind") == "TEST", F.concat(F.lit("tests/doc_"), base, F.lit(".test.ts"))).otherwise(F.concat(F.lit("src/doc_"), base, F.lit(".ts"))).alias("path"))


@query(f"SELECT t.file_id AS src, c.file_id AS dst, 'TESTS' AS kind FROM {_FILES} t JOIN {_FILES} c ON ends_with(t.path, '.test.ts') AND NOT ends_with(c.path, '.test.ts') AND replace(split_part(t.path, '/', -1), '.test.ts', '') = replace(split_part(c.path, '/', -1), '.ts', '')")
def j07_test_edges(spark, folder):
    return tests_of(_files(spark, folder))


_TREE = f"(SELECT unit_id AS file_id, repository_id || '/pkg' || (unit_id % 5) || '/sub' || (unit_id % 3) || '/f' || unit_id AS path FROM {UNITS})"
_CONFIGS = f"(SELECT unit_id AS config_id, CASE WHEN unit_id % 2 = 0 THEN repository_id || '/c.json' ELSE repository_id || '/pkg' || (unit_id % 5) || '/c.json' END AS path FROM {UNITS} WHERE unit_id % 50 = 3 OR unit_id % 50 = 4)"


@query(f"SELECT config_id AS src, file_id AS dst, 'CONFIGURES' AS kind FROM {_CONFIGS} c JOIN {_TREE} f ON starts_with(f.path, CASE WHEN contains(c.path, '/') THEN regexp_replace(c.path, '/[^/]*$', '') ELSE '' END)")
def j08_config_prefix(spark, folder):
    u = units(spark, folder).select("unit_id", "repository_id")
    s = lambda c, n: (F.col(c) % n).cast("string")
    tree = u.select(F.col("unit_id").alias("file_id"), F.concat("repository_id", F.lit("/pkg"), s("unit_id", 5), F.lit("/sub"), s("unit_id", 3), F.lit("/f"), F.col("unit_id").cast("string")).alias("path"))
    path = F.when(F.col("unit_id") % 2 == 0, F.concat("repository_id", F.lit("/c.json"))).otherwise(F.concat("repository_id", F.lit("/pkg"), s("unit_id", 5), F.lit("/c.json")))
    return configured(u.filter("unit_id % 50 = 3 or unit_id % 50 = 4").select(F.col("unit_id").alias("config_id"), path.alias("path")), tree)


@query(f"""WITH f AS (SELECT unit_id AS file_id, 'app/pkg' || (unit_id % 5) || '/m' || unit_id || '.ts' AS path FROM {UNITS}),
  s AS (SELECT file_id AS src, CASE file_id % 3 WHEN 0 THEN 'app/pkg' || (file_id % 5) || '/m' || (file_id + 5) WHEN 1 THEN 'app/pkg' || ((file_id + 1) % 5) || '/m' || (file_id + 1) || '.ts' ELSE 'app/none' END AS target FROM f)
  SELECT DISTINCT src, file_id AS dst, 'IMPORTS' AS kind FROM s JOIN f ON target = path OR target = regexp_replace(path, '\\.[a-z]+$', '')""")
def j09_import_edges(spark, folder):
    i = F.col("file_id")
    files = units(spark, folder).select(F.col("unit_id").alias("file_id")).select("file_id", F.concat(F.lit("app/pkg"), (i % 5).cast("string"), F.lit("/m"), i.cast("string"), F.lit(".ts")).alias("path"))
    spec = F.when(i % 3 == 0, F.concat(F.lit("./m"), (i + 5).cast("string"))).when(i % 3 == 1, F.concat(F.lit("../x/../pkg"), ((i + 1) % 5).cast("string"), F.lit("/./m"), (i + 1).cast("string"), F.lit(".ts"))).otherwise("../none")
    return imports(files.withColumn("specifier", spec), files)


@query("""WITH u AS (SELECT DISTINCT l_orderkey % 100 AS file, l_orderkey % 40 + 1 AS line, 'p' || (l_partkey % 20) AS name FROM lineitem),
  s AS (SELECT s_suppkey % 100 AS file, 's' || s_suppkey AS symbol, s_suppkey % 20 AS start, s_suppkey % 20 + s_suppkey % 23 AS "end" FROM supplier)
  SELECT file, line, name, symbol FROM (SELECT *, row_number() OVER (PARTITION BY file, line, name ORDER BY "end" - start, symbol) AS n FROM u JOIN s USING (file) WHERE line BETWEEN start AND "end") WHERE n = 1""")
def j10_enclosing_symbol(spark, folder):
    uses = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 100).alias("file"), (F.col("l_orderkey") % 40 + 1).alias("line"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("name")).distinct()
    k = F.col("s_suppkey")
    spans = table(spark, folder, "supplier").select((k % 100).alias("file"), F.concat(F.lit("s"), k.cast("string")).alias("symbol"), (k % 20).alias("start"), (k % 20 + k % 23).alias("end"))
    return enclosing(uses, spans).select("file", "line", "name", "symbol")


_SYMS = "(SELECT p_partkey AS dst, p_partkey % 40 AS file, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 6 END AS owner, 'f' || (p_partkey % 60) AS name FROM part)"


@query(f"""WITH u AS (SELECT DISTINCT p_partkey AS src, p_partkey % 40 AS file, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 6 END AS owner, 'f' || (p_partkey * 7 % 70) AS name FROM part),
  h AS (SELECT src, s.dst, u.name, CASE WHEN u.file = s.file AND u.owner = s.owner THEN 1 WHEN u.file = s.file THEN 2 ELSE 3 END AS level FROM u JOIN {_SYMS} s ON s.name = u.name)
  SELECT src, dst, name, level FROM (SELECT * FROM h QUALIFY level = min(level) OVER (PARTITION BY src, name)) WHERE src <> dst""")
def j10_call_resolution(spark, folder):
    k = F.col("p_partkey")
    owner = F.when(k % 3 > 0, k % 6).alias("owner")
    part = table(spark, folder, "part")
    name = lambda x: F.concat(F.lit("f"), x.cast("string")).alias("name")
    return resolve_calls(part.select(k.alias("src"), (k % 40).alias("file"), owner, name(k * 7 % 70)), part.select(k.alias("dst"), (k % 40).alias("file"), owner, name(k % 60)))


@query("SELECT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS kind, min(l_linenumber) AS line FROM lineitem GROUP BY ALL")
def u06_first_edges(spark, folder):
    e = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"))
    return first_edges(e, "line")


@query("""WITH RECURSIVE s AS (SELECT c_custkey AS snapshot_id, CASE WHEN c_custkey % 10 > 0 THEN c_custkey - 1 END AS parent_id FROM customer),
  r(snapshot_id, depth, ancestor) AS (SELECT snapshot_id, 0, snapshot_id FROM s UNION SELECT r.snapshot_id, depth + 1, parent_id FROM r JOIN s ON s.snapshot_id = r.ancestor WHERE parent_id IS NOT NULL AND depth < 10)
  SELECT snapshot_id, depth, ancestor FROM r""")
def w12_snapshot_chains(spark, folder):
    k = F.col("c_custkey")
    return chains(table(spark, folder, "customer").select(k.alias("snapshot_id"), F.when(k % 10 > 0, k - 1).alias("parent_id")), 10)


_ORIGINS = "CASE WHEN c_custkey % 1000 = 900 THEN c_custkey + 50 WHEN c_custkey % 500 > 0 THEN c_custkey - 1 WHEN c_custkey % 1500 = 1000 THEN -c_custkey END"


@query(f"""WITH RECURSIVE s AS (SELECT c_custkey AS id, {_ORIGINS} AS parent FROM customer), r(id, root, depth) AS (SELECT id, id, 0::BIGINT FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s) UNION ALL SELECT s.id, r.root, r.depth + 1 FROM r JOIN s ON s.parent = r.id)
  SELECT s.id AS snapshot_id, root, depth, r.id IS NULL AS cyclic FROM s LEFT JOIN r ON r.id = s.id""")
def w12_snapshot_roots(spark, folder):
    """The first ancestor of each snapshot and the steps to it, over chains of hundreds, lost parents and cycles."""
    return roots(table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.expr(_ORIGINS).alias("parent"))).withColumnRenamed("id", "snapshot_id")


_MODULE = """import { Base{j} } from './g{j}';
export class C{i} extends Base{j} implements I{j} {
  run{i}(x: T{j}) {
    helper{i}(x);
    this.go{i}(x);
  }
  go{i}(y: number) {
    return top{j}(y);
  }
}
export class Base{i} {}
interface I{i} { a: string }
type T{i} = string;
function helper{i}(z: string) { return z; }
export function top{i}(k: number) { return new C{i}(k); }
"""


def graph_files(spark, folder):
    """A module for each part, tests of every fourth one, and a config at the top of each package."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    # Keys of a few bytes stand for files that take milliseconds each: they are dealt over all tasks before their texts are made.
    part = table(spark, folder, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    body = F.replace(F.replace(F.lit(_MODULE), F.lit("{i}"), n), F.lit("{j}"), (k + 1).cast("string"))
    pkg = F.concat(F.lit("pkg"), F.expr("cast(p_partkey div 50 as string)"))
    modules = part.select((k * 10).alias("unit_id"), F.concat(F.lit("src/g"), n, F.lit(".ts")).alias("path"), F.lit("SOURCE_FILE").alias("kind"), body.alias("content"))
    tests = part.filter("p_partkey % 4 = 0").select((k * 10 + 1).alias("unit_id"), F.concat(pkg, F.lit("/g"), n, F.lit(".test.ts")).alias("path"), F.lit("TEST").alias("kind"), F.lit("").alias("content"))
    configs = part.filter("p_partkey % 50 = 0").select((k * 10 + 2).alias("unit_id"), F.concat(pkg, F.lit("/tsconfig.json")).alias("path"), F.lit("CONFIG").alias("kind"), F.lit("").alias("content"))
    return modules.unionByName(tests).unionByName(configs)


#: Symbols of a module in order, and the edges that its text makes: from, to (with j for the next module's), kind, confidence.
_SYMBOLS_OF = ["C", "run", "go", "Base", "I", "T", "helper", "top"]
_WITHIN = [("C", "Base+", "INHERITS", 0.85), ("C", "Base+", "TYPE_USES", 0.85), ("C", "I+", "IMPLEMENTS", 0.85), ("C", "I+", "TYPE_USES", 0.85), ("run", "T+", "TYPE_USES", 0.8), ("run", "helper", "CALLS", 0.7), ("run", "go", "CALLS", 0.7), ("go", "top+", "CALLS", 0.7), ("top", "C", "CALLS", 0.7),
    ("file", "Base+", "REFERENCES", 0.7), ("C", "Base+", "REFERENCES", 0.7), ("C", "I+", "REFERENCES", 0.7), ("run", "go", "REFERENCES", 0.7)]


def _graph_sql():
    sym = lambda n, k="k": f"'f' || ({k} * 10)" if n == "file" else f"'f' || ({k} * 10) || '#{_SYMBOLS_OF.index(n)}'"
    parts = [f"SELECT 'f' || (k * 10) AS src, {sym(n)} AS dst, 'CONTAINS' AS kind, 1.0::DOUBLE AS confidence FROM m" for n in _SYMBOLS_OF] + [f"SELECT {sym(n)}, 'f' || (k * 10), 'DECLARED_IN', 1.0 FROM m" for n in _SYMBOLS_OF]
    parts += ["SELECT 'f' || (k * 10 + 1), 'f' || (k * 10), 'TESTS', 0.95 FROM m WHERE k % 4 = 0", *[f"SELECT 'f' || (k * 10 + 1), {sym(n)}, 'TESTS', 0.9 FROM m WHERE k % 4 = 0" for n in _SYMBOLS_OF]]
    parts.append("SELECT 'f' || (c.k * 10 + 2), 'f' || (t.k * 10 + t.o), 'CONFIGURES', 0.8 FROM m c JOIN (SELECT k, 1 AS o FROM m WHERE k % 4 = 0 UNION ALL SELECT k, 2 FROM m WHERE k % 50 = 0) t ON starts_with('pkg' || (t.k // 50), 'pkg' || (c.k // 50)) WHERE c.k % 50 = 0 AND NOT (t.k = c.k AND t.o = 2)")
    parts.append("SELECT 'f' || (k * 10), 'f' || ((k + 1) * 10), 'IMPORTS', 0.9 FROM m WHERE k + 1 IN (SELECT k FROM m)")
    for a, b, kind, confidence in _WITHIN:
        after = b.endswith("+")
        parts.append(f"SELECT {sym(a)}, {sym(b.rstrip('+'), '(k + 1)' if after else 'k')}, '{kind}', {confidence} FROM m" + (" WHERE k + 1 IN (SELECT k FROM m)" if after else ""))
    return f"WITH m AS (SELECT p_partkey AS k FROM part) {' UNION ALL '.join(parts)}"


@query(_graph_sql())
def g01_graph_build(spark, folder):
    """The ten kinds of edges between modules, their symbols, tests and configs."""
    files = graph_files(spark, folder)
    found = symbols(files)
    place = F.row_number().over(Window.partitionBy("unit_id").orderBy("start_byte")) - 1
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    held = found.select(F.concat(name("unit_id"), F.lit("#"), place.cast("string")).alias("symbol_id"), name("unit_id").alias("file_id"), "name", F.col("parent").alias("owner"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return build_graph(files.select(name("unit_id").alias("file_id"), "path", "kind"), held, uses(files).select(name("unit_id").alias("file_id"), "use", "name", "line"))
