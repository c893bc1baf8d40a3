"""Queries of sources and sinks."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.paths import artifact_kind, trust_level
from tessera.operators.snapshots import HashTree
from tessera.operators.substring import LineIndex
from tessera.registry import query
from tessera.sources.code import index_edges, read_symbol_index, repository_files, skeletons, symbols, written_files
from tessera.sources.sinks import read_csv, write_csv
from tessera.sources.tables import UNITS, table, units
from tessera.storage import new_folder, shared_folder, shared_uri


def c(name):
    return F.col(name)


def dealt(spark, parts):
    """Rows of the part table, few bytes each, that stand for files which take milliseconds each: dealt over all tasks before these are made."""
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


PATHS = ["package-lock.json", "src/Cargo.toml", "migrations/001.sql", "db/schema.sql", "tests/a.ts", "src/x.test.ts", "pkg/b_test.go", "test_c.py", "README", "docs/a/b.txt", "guide.RST", "tsconfig.base.json", "app.config.js", "Dockerfile", "src/main.ts", "node_modules/x/y.js", "dist/a.js", "lib/app.min.js", "src\\\\generated\\\\z.ts", "api/openapi.yaml", ".env.local", "vendor/q.go", "src/alembic/v.py", "k/spec.rb"]
ORIGINS = ["LOCAL_FIRST_PARTY", "DEPENDENCY", "GENERATED", "CLONED_EXTERNAL", "UNKNOWN"]
_LIST = "[" + ", ".join("'" + p.replace("\\\\", "\\") + "'" for p in PATHS) + "]"
_PATHS = f"(SELECT p_partkey AS unit_id, {_LIST}[CAST(p_partkey % {len(PATHS)} + 1 AS INT)] AS path, {ORIGINS}[CAST(p_size % 5 + 1 AS INT)] AS origin FROM part)"
_P = "lower(replace(path, '\\', '/'))"
_LAST = f"split_part({_P}, '/', -1)"
_KIND = f"""CASE WHEN {_LAST} IN ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'cargo.lock', 'go.sum', 'poetry.lock', 'pipfile.lock', 'gemfile.lock', 'composer.lock') THEN 'LOCKFILE'
  WHEN {_LAST} IN ('package.json', 'cargo.toml', 'go.mod', 'pyproject.toml', 'requirements.txt', 'gemfile', 'composer.json', 'pom.xml', 'build.gradle') THEN 'MANIFEST'
  WHEN starts_with({_P}, 'migration') OR contains({_P}, '/migration') OR starts_with({_P}, 'migrate') OR contains({_P}, '/migrate') OR contains({_P}, 'alembic') OR contains({_P}, 'flyway') OR contains({_LAST}, 'migration') THEN 'MIGRATION'
  WHEN ends_with({_P}, '.prisma') OR ends_with({_P}, '.graphql') OR ends_with({_P}, '.gql') OR ends_with({_P}, '.proto') OR ends_with({_P}, 'schema.sql') OR contains({_LAST}, 'openapi') OR contains({_LAST}, 'swagger') THEN 'SCHEMA'
  WHEN starts_with({_P}, 'test/') OR starts_with({_P}, 'tests/') OR starts_with({_P}, '__tests__/') OR contains({_P}, '/test/') OR contains({_P}, '/tests/') OR contains({_P}, '/__tests__/') OR ends_with({_P}, '.test.ts') OR ends_with({_P}, '.test.js') OR ends_with({_P}, '.spec.ts') OR ends_with({_P}, '.spec.js')
   OR ends_with({_P}, '_test.go') OR starts_with({_LAST}, 'test_') OR ends_with({_P}, '_test.py') THEN 'TEST'
  WHEN ends_with({_P}, '.md') OR ends_with({_P}, '.markdown') OR ends_with({_P}, '.rst') OR starts_with({_LAST}, 'readme') OR starts_with({_LAST}, 'license') OR starts_with({_P}, 'docs/') OR contains({_P}, '/docs/') THEN 'DOCUMENTATION'
  WHEN starts_with({_LAST}, 'tsconfig') OR starts_with({_LAST}, '.eslint') OR starts_with({_LAST}, '.prettier') OR ends_with({_P}, '.config.js') OR ends_with({_P}, '.config.ts') OR ends_with({_P}, '.config.mjs') OR ends_with({_P}, '.config.json') OR {_LAST} = 'dockerfile' OR starts_with({_LAST}, 'docker-compose') OR starts_with({_LAST}, '.env') THEN 'CONFIG'
  ELSE 'SOURCE_FILE' END"""


def _paths(spark, folder):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v.replace("\\\\", "\\")) for v in values]), (n % len(values) + 1).cast("int"))
    return table(spark, folder, "part").select(c("p_partkey").alias("unit_id"), pick(PATHS, c("p_partkey")).alias("path"), pick(ORIGINS, c("p_size")).alias("origin"))


@query(f"SELECT unit_id, {_KIND} AS kind FROM {_PATHS}")
def s03_artifact_kind(spark, folder):
    return _paths(spark, folder).select("unit_id", artifact_kind(c("path")).alias("kind"))


@query(f"""SELECT unit_id, CASE WHEN starts_with(p, 'node_modules/') OR starts_with(p, 'vendor/') THEN 'DEPENDENCY' WHEN starts_with(p, 'dist/') OR starts_with(p, 'build/') OR ends_with(p, '.min.js') OR contains(p, '/generated/') THEN 'GENERATED'
  WHEN origin IN ('DEPENDENCY', 'GENERATED') THEN origin WHEN origin = 'CLONED_EXTERNAL' THEN 'EXTERNAL_SOURCE' WHEN origin = 'UNKNOWN' THEN CASE WHEN kind = 'DOCUMENTATION' THEN 'UNTRUSTED' ELSE 'EXTERNAL_SOURCE' END
  WHEN kind IN ('CONFIG', 'MANIFEST', 'LOCKFILE') THEN 'FIRST_PARTY_CONFIGURATION' WHEN kind = 'DOCUMENTATION' THEN 'FIRST_PARTY_DOCUMENTATION' ELSE 'FIRST_PARTY_CODE' END AS trust FROM (SELECT *, {_P} AS p, {_KIND} AS kind FROM {_PATHS})""")
def s04_trust_level(spark, folder):
    return _paths(spark, folder).select("unit_id", trust_level(c("path"), artifact_kind(c("path")), c("origin")).alias("trust"))


_TREE = ["src/a{i}.ts", "node_modules/x{i}.js", "vendor/q{i}.go", "lib/b{i}.min.js", ".git/h{i}", "docs/c {i}+%25.md", "dist/d{i}.js", "app/dist{i}.js", "img/e{i}.png", "coverage/f{i}.txt", "k/.hidden{i}", "build.d/g{i}.map.ts", "deep/build/h{i}.ts", "bad/i{i}.bin"]
_TREE_SQL = "[" + ", ".join(f"'{p}'" for p in _TREE) + f"][CAST(p_partkey % {len(_TREE)} + 1 AS INT)]"


@query(f"""SELECT path, length(p_name)::BIGINT + CASE WHEN starts_with(path, 'bad/') THEN 1 ELSE 0 END AS size, NOT starts_with(path, 'bad/') AS readable FROM (SELECT *, replace({_TREE_SQL}, '{{i}}', p_partkey::VARCHAR) AS path FROM part)
  WHERE NOT regexp_matches(path, '(^|/)(node_modules|[.]git|dist|build|benchmarks|[.]next|[.]venv|__pycache__)/') AND NOT regexp_matches(path, '[.](min[.]js|min[.]css|map|png|jpg|jpeg|gif|svg|ico|woff|woff2)$') AND NOT regexp_matches(path, '(^|/)[.]')""")
def s01_repository_scan(spark, folder):
    """A repository of one file for each part, written below the shared folder and scanned: folders, endings and hidden files that are left out."""
    k = c("p_partkey")
    path = F.replace(F.element_at(F.array(*map(F.lit, _TREE)), (k % len(_TREE) + 1).cast("int")), F.lit("{i}"), k.cast("string"))
    files = dealt(spark, table(spark, folder, "part").select("p_partkey", "p_name")).select(path.alias("path"), c("p_name").cast("binary").alias("content"))
    files = files.withColumn("content", F.when(c("path").startswith("bad/"), F.concat("content", F.unhex(F.lit("FF")))).otherwise(c("content")))
    root = f"{shared_uri(spark)}/tessera/tree.d-{uuid.uuid4().hex}"
    written_files(files, root)
    return repository_files(spark, root).select("path", "size", "readable")


@query(f"SELECT repository_id, count(*) AS files, count(*) FILTER (WHERE lang <> 'fr') AS parsed, round(count(*) FILTER (WHERE lang <> 'fr') / count(*), 2) AS coverage, greatest(0.5, 1 - count(*) FILTER (WHERE unit_id % 9 = 0) / count(*)) AS confidence FROM {UNITS} GROUP BY ALL")
def s05_quality_statistics(spark, folder):
    n = F.count(F.lit(1))
    parsed, errors = F.count_if(c("lang") != "fr"), F.count_if(c("unit_id") % 9 == 0)
    return units(spark, folder).groupBy("repository_id").agg(n.alias("files"), parsed.alias("parsed"), F.round(parsed / n, 2).alias("coverage"), F.greatest(F.lit(0.5), 1 - errors / n).alias("confidence"))


@query("SELECT p_partkey AS unit_id, CASE WHEN p_partkey % 11 = 0 THEN 'OUTSIDE_WORKSPACE' WHEN p_partkey % 7 = 0 THEN 'FILE_NOT_FOUND' WHEN p_partkey % 5 = 0 THEN 'WORKSPACE_CHANGED' ELSE 'OK' END AS status FROM part")
def s18_snapshot_check(spark, folder):
    part = table(spark, folder, "part")
    expected = part.select(c("p_partkey").alias("unit_id"), F.when(c("p_partkey") % 11 == 0, F.concat(F.lit("../"), c("p_name"))).otherwise(c("p_name")).alias("path"), F.sha2("p_name", 256).alias("expected"))
    observed = part.filter("p_partkey % 7 > 0").select(c("p_partkey").alias("unit_id"), F.sha2(F.when(c("p_partkey") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(c("p_name")), 256).alias("observed"))
    status = F.when(c("path").startswith("../"), "OUTSIDE_WORKSPACE").when(c("observed").isNull(), "FILE_NOT_FOUND").when(c("observed") != c("expected"), "WORKSPACE_CHANGED").otherwise("OK")
    return expected.join(observed, "unit_id", "left").select("unit_id", status.alias("status"))


@query(f"""WITH h AS (SELECT repository_id, unit_id || '=' || sha256(content) AS h, substr(sha256(unit_id::VARCHAR), 1, 2) AS part FROM {UNITS}),
  p AS (SELECT repository_id, part, sha256(string_agg(h, ';' ORDER BY h)) AS ph FROM h GROUP BY ALL) SELECT repository_id, sha256(string_agg(part || ph, ';' ORDER BY part)) AS snapshot_hash FROM p GROUP BY repository_id""")
def s19_snapshot_hash(spark, folder):
    """A snapshot's hash over its files' hashes: 256 parts by the hash of the file's key, each over its files in order, then over the parts."""
    key = c("unit_id").cast("string")
    rows = units(spark, folder).select("repository_id", F.substring(F.sha2(key, 256), 1, 2).alias("part"), F.concat_ws("=", key, F.sha2("content", 256)).alias("h"))
    joined = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), ";"), 256)
    parts = rows.groupBy("repository_id", "part").agg(joined(c("h")).alias("h"))
    return parts.groupBy("repository_id").agg(joined(F.concat("part", "h")).alias("snapshot_hash"))


_CODE = {
    ".py": '@deco\nclass A{i}:\n    def run(self):\n        return {i}\n\ndef top{i}(x):\n    if x:\n        return 1\n    return 2\n',
    ".ts": 'export class A{i} {\n  run(x: number) {\n    return "}" + x; // }\n  }\n}\nexport function top{i}(a: string) {\n  return a;\n}\ninterface I{i} { a: string }\n',
    ".go": "package m\n\ntype A{i} struct {\n\tx int\n}\n\nfunc (a A{i}) Run() int {\n\treturn a.x\n}\n\nfunc Top{i}() string {\n\treturn \"{\"\n}\n",
    ".rs": "#[derive(Clone)]\npub struct A{i} {\n  x: i32,\n}\nimpl<T> Show<T> for A{i} {\n  pub fn run(&self) -> i32 { self.x }\n}\nfn top{i}() {\n  /* } */\n}\nmacro_rules! m{i} {\n  () => { 1; }\n}\n",
    ".txt": "nothing {i}\n",
}


def code_files(spark, folder):
    """Small source files in four languages, one for each part."""
    k = c("p_partkey")
    ext = list(_CODE)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(ext) + 1).cast("int"))
    content = F.replace(pick([v for v in _CODE.values()]), F.lit("{i}"), k.cast("string"))
    return dealt(spark, table(spark, folder, "part").select("p_partkey")).select(k.alias("unit_id"), F.concat(F.lit("src/f"), k.cast("string"), pick(ext)).alias("path"), content.alias("content"))


#: Symbols of each template: extension's place, kind, name, qualified name, lines, first letters, last letters (both found once in the text), head, class, decorated.
_HELD = [
    (0, "class", "A{i}", "A{i}", 1, 4, "@deco", "        return {i}", "class A{i}:", None, True), (0, "method", "run", "A{i}.run", 3, 4, "    def run", "        return {i}", "def run(self):", "A{i}", False), (0, "function", "top{i}", "top{i}", 6, 9, "def top", "1|    return 2", "def top{i}(x):", None, False),
    (1, "class", "A{i}", "A{i}", 1, 5, "export class", "  }|}", "export class A{i}", None, False), (1, "method", "run", "A{i}.run", 2, 4, "run(x", "// }|  }", "run(x: number)", "A{i}", False), (1, "function", "top{i}", "top{i}", 6, 8, "export function", "return a;|}", "export function top{i}(a: string)", None, False), (1, "interface", "I{i}", "I{i}", 9, 9, "interface", "a: string }", "interface I{i}", None, False),
    (2, "class", "A{i}", "A{i}", 3, 5, "type A", "x int|}", "type A{i} struct", None, False), (2, "method", "Run", "A{i}.Run", 7, 9, "func (a", "a.x|}", "func (a A{i}) Run() int", "A{i}", False), (2, "function", "Top{i}", "Top{i}", 11, 13, "func Top", '"{"|}', "func Top{i}() string", None, False),
    (3, "class", "A{i}", "A{i}", 1, 4, "#[derive", "i32,|}", "pub struct A{i}", None, True), (3, "impl", "A{i}", "impl A{i}", 5, 7, "impl<T>", "self.x }|}", "impl<T> Show<T> for A{i}", None, False), (3, "method", "run", "A{i}::run", 6, 6, "pub fn", "self.x }", "pub fn run(&self) -> i32", "A{i}", False), (3, "function", "top{i}", "top{i}", 8, 10, "fn top", "/* } */|}", "fn top{i}()", None, False),
    (3, "function", "m{i}", "m{i}", 11, 13, "macro_rules!", "1; }|}", "macro_rules! m{i}", None, True),
]


def _held_sql():
    said = lambda x: "NULL::VARCHAR" if x is None else "replace('" + x.replace("'", "''").replace("|", "' || chr(10) || '") + "', '{i}', p_partkey::VARCHAR)"
    texts = ["replace('" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "', '{i}', p_partkey::VARCHAR)" for t in _CODE.values()]
    rows = []
    for ext, kind, name, qualified, first, last, head, tail, signature, parent, decorated in _HELD:
        text = texts[ext]
        rows.append(f"SELECT p_partkey AS unit_id, '{kind}' AS kind, {said(name)} AS name, {said(qualified)} AS qualified_name, {first} AS start_line, {last} AS end_line, strpos({text}, {said(head)}) - 1 AS start_byte, strpos({text}, {said(tail)}) - 1 + length({said(tail)}) AS end_byte, {said(signature)} AS signature, {said(parent)} AS parent, {decorated} AS unsafe FROM part WHERE p_partkey % 5 = {ext}")
    return " UNION ALL ".join(rows)


@query(_held_sql())
def s06_symbols(spark, folder):
    """Symbols of Python, TypeScript, Go and Rust files by extension (s06 to s09), with spans by line and byte, heads and classes; other files have none."""
    return symbols(code_files(spark, folder)).select("unit_id", "kind", "name", "qualified_name", "start_line", "end_line", "start_byte", "end_byte", "signature", "parent", "unsafe")


@query("SELECT p_partkey AS unit_id, 'top' || p_partkey AS name, 6 AS start_line, 9 AS end_line FROM part WHERE p_partkey % 5 = 0")
def s07_python_functions(spark, folder):
    rows = symbols(code_files(spark, folder).filter("unit_id % 5 = 0")).filter("kind = 'function'")
    return rows.select("unit_id", "name", "start_line", "end_line")


@query("SELECT p_partkey AS unit_id, 'Top' || p_partkey AS name, 11 AS start_line, 13 AS end_line FROM part WHERE p_partkey % 5 = 2")
def s08_go_functions(spark, folder):
    rows = symbols(code_files(spark, folder).filter("unit_id % 5 = 2")).filter("kind = 'function'")
    return rows.select("unit_id", "name", "start_line", "end_line")


@query("SELECT p_partkey AS unit_id, 'file' AS level FROM part UNION ALL SELECT p_partkey, 'symbol' FROM part, range(0, 5) r(n) WHERE n < CASE p_partkey % 5 WHEN 4 THEN 0 WHEN 1 THEN 4 WHEN 3 THEN 5 ELSE 3 END")
def s02_content_units(spark, folder):
    """One unit for each file and one for each of its symbols."""
    files = code_files(spark, folder)
    return files.select("unit_id", F.lit("file").alias("level")).unionAll(symbols(files).select("unit_id", F.lit("symbol").alias("level")))


#: What is left of each template without its functions' bodies.
_BARE = [
    "@deco|class A{i}:||    def run(self):|        ...||def top{i}(x):|    ...",
    "export class A{i} {|  run(x: number) { ... }|}|export function top{i}(a: string) { ... }|interface I{i} { a: string }|",
    "package m||type A{i} struct {|\tx int|}||func (a A{i}) Run() int { ... }||func Top{i}() string { ... }|",
    "#[derive(Clone)]|pub struct A{i} {|  x: i32,|}|impl<T> Show<T> for A{i} {|  pub fn run(&self) -> i32 { ... }|}|fn top{i}() { ... }|macro_rules! m{i} {|  () => { 1; }|}|",
    "nothing {i}|",
]
_BARE_SQL = "[" + ", ".join("replace('" + x.replace("\t", "' || chr(9) || '") + "', '|', chr(10))" for x in _BARE) + "][CAST(p_partkey % 5 + 1 AS INT)]"


@query(f"SELECT p_partkey AS unit_id, replace({_BARE_SQL}, '{{i}}', p_partkey::VARCHAR) AS skeleton FROM part")
def r21_skeletons(spark, folder):
    """Files without the bodies of their functions, as text."""
    return skeletons(code_files(spark, folder)).select("unit_id", "skeleton")


@query("""WITH u AS (SELECT p_partkey AS unit_id, 'f' || (p_partkey // 4) AS title, 'src/a' || p_partkey AS path FROM part),
  occ AS (SELECT DISTINCT p_partkey % 50 AS f, (p_partkey * 7 % 1000) // 4 AS n FROM part WHERE p_partkey % 7 <> 0),
  rel AS (SELECT DISTINCT p_partkey // 4 AS a, p_partkey // 4 + 1 AS b, CASE WHEN p_partkey % 2 = 0 THEN 'IMPLEMENTS' WHEN p_partkey % 3 = 0 THEN 'TYPE_USES' ELSE 'REFERENCES' END AS kind FROM part WHERE p_partkey % 5 = 0)
  SELECT src, dst, kind, max(confidence)::DOUBLE AS confidence FROM (SELECT d.unit_id AS src, t.unit_id AS dst, 'REFERENCES' AS kind, 0.98 AS confidence FROM occ JOIN u d ON d.path = 'src/a' || f JOIN u t ON t.title = 'f' || n WHERE t.unit_id <> d.unit_id
   UNION ALL SELECT s.unit_id, t.unit_id, kind, 1.0 FROM rel JOIN u s ON s.title = 'f' || a JOIN u t ON t.title = 'f' || b) GROUP BY ALL""")
def s11_symbol_index(spark, folder):
    """Symbol indexes as JSON files, one for each of fifty documents, read and turned into edges: references and relationships."""
    k = c("p_partkey")
    s = lambda x: x.cast("string")
    occurrence = F.struct(F.concat(F.lit("npm pkg 1.0 src/lib#f"), s(F.expr("p_partkey * 7 % 1000 div 4")), F.lit("()")).alias("symbol"), F.when(k % 7 == 0, 1).when(k % 3 == 0, 8).otherwise(2).alias("symbolRoles"))
    related = F.struct(F.concat(F.lit("pkg/f"), s(F.expr("p_partkey div 4 + 1")), F.lit("#")).alias("symbol"), (k % 2 == 0).alias("isImplementation"), F.when(k % 3 == 0, True).alias("isTypeDefinition"))
    symbol = F.when(k % 5 == 0, F.struct(F.concat(F.lit("pkg/f"), s(F.expr("p_partkey div 4")), F.lit("#")).alias("symbol"), F.array(related).alias("relationships")))
    docs = table(spark, folder, "part").groupBy((k % 50).alias("f")).agg(F.collect_list(occurrence).alias("occurrences"), F.collect_list(symbol).alias("symbols"))
    where = f"{shared_folder(spark)}/tessera/index-{uuid.uuid4().hex}"
    path = F.when(c("f") % 2 == 0, F.concat(F.lit("src/a"), s(c("f")))).otherwise(F.concat(F.lit("src\\a"), s(c("f"))))
    docs.select("f", F.array(F.struct(path.alias("relative_path"), "symbols", "occurrences")).alias("documents")).write.partitionBy("f").json(where)
    _, index = read_symbol_index(spark, where, "CI_PRECISE")
    return index_edges(index, table(spark, folder, "part").select(k.alias("unit_id"), F.concat(F.lit("src/a"), s(k)).alias("path"), F.concat(F.lit("f"), s(F.expr("p_partkey div 4"))).alias("title")))


@query("SELECT l_orderkey AS task_id, sha256(string_agg('<context_unit id=\"' || l_partkey || '\" line=\"' || l_linenumber || '\">' || l_returnflag || '</context_unit>', chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag)) AS rendered FROM lineitem GROUP BY ALL")
def s17_render(spark, folder):
    part = F.concat(F.lit('<context_unit id="'), c("l_partkey").cast("string"), F.lit('" line="'), c("l_linenumber").cast("string"), F.lit('">'), c("l_returnflag"), F.lit("</context_unit>"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("s"))))
    return table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("task_id")).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["s"]), "\n"), 256).alias("rendered"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s12_typed_table(spark, folder):
    """A table read with its explicit schema, as stored ones are."""
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(f"{folder}/nation.parquet")


@query("""SELECT conv_id, turn, sha256('say "' || role || '",' || chr(10) || text) AS cell FROM conversations""")
def s16_csv_export(spark, folder):
    """Rows written as CSV (every cell quoted, quotes doubled, line feeds within cells) and read again."""
    where = f"{shared_folder(spark)}/tessera/csv-{uuid.uuid4().hex}"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit('say "'), c("role"), F.lit('",\n'), c("text")).alias("cell"))
    write_csv(rows, where)
    return read_csv(spark, where, "conv_id long, turn int, cell string").select("conv_id", c("turn").cast(rows.schema["turn"].dataType).alias("turn"), F.sha2("cell", 256).alias("cell"))


@query("SELECT event_id, json_extract_string(p, '$.id')::BIGINT AS id, json_extract_string(p, '$.type') AS type FROM (SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS p FROM events)")
def s15_json_round_trip(spark, folder):
    """Events written as JSON files and read again by their schema."""
    where = f"{shared_folder(spark)}/tessera/json-{uuid.uuid4().hex}"
    table(spark, folder, "events").select("event_id", c("event_id").alias("id"), c("event_type").alias("type")).write.json(where)
    return spark.read.schema("event_id long, id long, type string").option("mode", "FAILFAST").json(where)


@query(f"SELECT unit_id, n AS line FROM (SELECT unit_id, unnest(regexp_split_to_array(content, chr(10))) AS l, generate_subscripts(regexp_split_to_array(content, chr(10)), 1) AS n FROM {UNITS}) WHERE contains(l, 'tion') ORDER BY unit_id, n LIMIT 50")
def k07_substring_search(spark, folder):
    lines = units(spark, folder).select("unit_id", F.posexplode(F.split("content", "\n", -1)).alias("n", "l"))
    return lines.filter(c("l").contains("tion")).select("unit_id", (c("n") + 1).alias("line")).orderBy("unit_id", "line").limit(50)


_SOUGHT = "(SELECT item_id AS needle_id, substr(text, 1 + item_id % 20, 9 + item_id % 5) AS needle FROM benchmark UNION ALL SELECT 100000 + item_id, substr(text, 2, 2) FROM benchmark WHERE item_id % 50 = 7)"


@query(f"""SELECT needle_id, unit_id, n AS line FROM (SELECT needle_id, unit_id, n, row_number() OVER (PARTITION BY needle_id ORDER BY unit_id, n) AS place FROM
  (SELECT unit_id, unnest(regexp_split_to_array(content, chr(10))) AS l, generate_subscripts(regexp_split_to_array(content, chr(10)), 1) AS n FROM {UNITS}) JOIN {_SOUGHT} ON contains(l, needle)) WHERE place <= 50""")
def k07_indexed_search(spark, folder):
    """The first fifty lines that hold each of many needles, by an index of grams."""
    item = c("item_id")
    text = table(spark, folder, "benchmark")
    needles = text.select(item.alias("needle_id"), F.substring(c("text"), (1 + item % 20).cast("int"), (9 + item % 5).cast("int")).alias("needle"))
    needles = needles.unionByName(text.filter("item_id % 50 = 7").select((item + 100000).alias("needle_id"), F.substring("text", 2, 2).alias("needle")))
    index = LineIndex.build(units(spark, folder), new_folder(spark, "line-index"))
    place = F.row_number().over(Window.partitionBy("needle_id").orderBy("unit_id", "line"))
    return index.search(needles).withColumn("place", place).filter("place <= 50").drop("place")


#: Snapshots of the units: as they are, and after a change, with files that were changed, removed and added.
_TAKEN = f"""(SELECT 'before' AS snapshot_id, path, sha256(coalesce(content, '')) AS content_hash FROM {UNITS} WHERE unit_id % 101 <> 7
  UNION ALL SELECT 'after', path, sha256(coalesce(content, '') || CASE WHEN unit_id % 97 = 5 THEN '!' ELSE '' END) FROM {UNITS} WHERE unit_id % 89 <> 3)"""


@query(f"""WITH s AS (SELECT * FROM {_TAKEN}) SELECT path, CASE WHEN a.path IS NULL THEN 'ADDED' WHEN b.path IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM (SELECT * FROM s WHERE snapshot_id = 'before') a
  FULL JOIN (SELECT * FROM s WHERE snapshot_id = 'after') b USING (path) WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def s19_snapshot_changes(spark, folder):
    """What differs between two snapshots, by their hash trees."""
    u, text = units(spark, folder), F.coalesce("content", F.lit(""))
    before = u.filter("unit_id % 101 <> 7").select(F.lit("before").alias("snapshot_id"), "path", F.sha2(text, 256).alias("content_hash"))
    after = u.filter("unit_id % 89 <> 3").select(F.lit("after").alias("snapshot_id"), "path", F.sha2(F.concat(text, F.when(c("unit_id") % 97 == 5, "!").otherwise("")), 256).alias("content_hash"))
    tree = HashTree.build(before.unionByName(after), new_folder(spark, "hash-tree"), u.count())
    return tree.changes(spark.createDataFrame([("before", "after")], "old string, new string")).select("path", "change")
