"""Names, heads and spans of symbols in shapes beyond the queries' templates, and the scanners' growth."""

import random
import time

import pytest

from tessera.sources.code import brace_symbols, skeleton_of, typescript_uses, without_literals

GO = """package m

type Stack[T any] struct { items []T }
type Shower interface { Show() string }

func (s *Stack[T]) Push(x T) { s.items = append(s.items, x) }
func(Stack[T]) Pop() (int, error) {
	if true { return 0, nil } // }
	return 1, nil
}
func New() *Stack[int] { return nil }
"""
RUST = """macro_rules! define { ($x:expr) => { fn made() { $x } }; }

#[derive(Debug, Clone)]
pub(crate) struct Pool<T> where T: Send { size: usize }

impl<T: Send> Pool<T> {
    #[inline]
    pub async fn execute(&self, job: T) -> Result<(), Error> {
        fn nested() {}
        Ok(())
    }
}
impl fmt::Display for Pool<u8> {
    unsafe fn fmt(&self) -> usize { self.size }
}
pub trait Job {
    fn run(&self);
}
fn main() { let s = "impl Fake { fn no() {} }"; }
"""


def named(text, language):
    return {x["qualified_name"]: x for x in brace_symbols(text, language)}


def test_go_methods_are_named_by_their_receivers():
    got = named(GO, "go")
    assert {k: (x["kind"], x["parent"], x["start_line"], x["end_line"]) for k, x in got.items()} == {
        "Stack": ("class", None, 3, 3), "Shower": ("interface", None, 4, 4), "Stack.Push": ("method", "Stack", 6, 6), "Stack.Pop": ("method", "Stack", 7, 10), "New": ("function", None, 11, 11)}


def test_rust_methods_impls_macros_and_attributes():
    got = brace_symbols(RUST, "rs")
    shown = [(x["kind"], x["name"], x["qualified_name"], x["parent"], x["start_line"], x["end_line"], x["unsafe"]) for x in got]
    assert shown == [
        ("function", "define", "define", None, 1, 1, True), ("class", "Pool", "Pool", None, 3, 4, True), ("impl", "Pool", "impl Pool", None, 6, 12, False),
        ("method", "execute", "Pool::execute", "Pool", 7, 11, True), ("impl", "Pool", "impl Pool", None, 13, 15, False), ("method", "fmt", "Pool::fmt", "Pool", 14, 14, False),
        ("interface", "Job", "Job", None, 16, 18, False), ("function", "main", "main", None, 19, 19, False)]
    assert got[3]["signature"] == "pub async fn execute(&self, job: T) -> Result<(), Error>"
    text = RUST.encode()
    assert text[got[3]["start_byte"] : got[3]["end_byte"]].decode().startswith("#[inline]") and text[got[3]["start_byte"] : got[3]["end_byte"]].decode().endswith("Ok(())\n    }")


def test_spans_in_bytes_after_letters_of_several_bytes():
    text = "// é 中 🙂\nexport class Ä {\n  run() { return '}é'; }\n}\n"
    a, b = brace_symbols(text, "ts")
    cut = lambda x: text.encode()[x["start_byte"] : x["end_byte"]].decode()
    assert cut(a) == text.split("\n", 1)[1].rstrip() and (a["start_line"], a["end_line"]) == (2, 4)
    assert cut(b) == "run() { return '}é'; }" and b["qualified_name"] == "Ä.run"


def test_skeleton_leaves_functions_in_strings_alone():
    assert skeleton_of("a.ts", 'const s = "\\nfunction f() { x }";\nfunction g() { return 1; }\n') == 'const s = "\\nfunction f() { x }";\nfunction g() { ... }\n'


def test_import_statements_of_all_forms():
    said = ["import 'a'", 'import b from "b"', "import * as c from 'c'", "import d, { e as f, type G } from './d'", "import {\n  h,\n  i,\n} from '../h'", "export * from 'j'", "export { k } from 'k'", "import type { L } from 'l'"]
    text = "\n".join(said) + "\nexport class M { from = 1; x = f(from, 'no') }\nexport const n = (from) => from + 'no'\n"
    assert [n for use, n, _ in typescript_uses(text) if use == "import"] == ["a", "b", "c", "./d", "../h", "j", "k", "l"]


#: Pieces of text by language, each with the symbols it makes: qualified name (# stands for the piece's number), first line, last line.
SHAPES = {
    "ts": [
        ("export class A# {\n  a() { return `x ${ `}` + f({b: \"y\"}) } {`; }\n  b(s: string) { return s.replace(/[{\"'/]/g, '') / 2 / s.length; }\n}\n", [("A#", 1, 4), ("A#.a", 2, 2), ("A#.b", 3, 3)]),
        ("function d#() {\n  const x = `open ${a ? `${b}}` : \"}\"} \\` {`;\n}\n", [("d#", 1, 3)]),
        ("// it's a remark with ` and {\n/* another { ' */\nasync function g#<T extends { a: string }>(x: T) { return /}/.test(x) }\n", [("g#", 3, 3)]),
        ("interface I# {\n  a: string\n}\nenum E# { X }\ntype T#<K> = { k: K };\n", [("I#", 1, 3), ("E#", 4, 4), ("T#", 5, 5)]),
        ("export function f#({ a, b }: { a: number; b: string }, c = { d: 1 }): { e: number } {\n  return { e: a };\n}\n", [("f#", 1, 3)]),
        ("declare function o#(x: string): void\nfunction o#b(x: number[]): Map<string, { a: 1 }> { return x }\ntype L# = {\n  a: string;\n}\ntype M# = L#\n", [("o#", 1, 1), ("o#b", 2, 2), ("L#", 3, 5), ("M#", 6, 6)]),
        ("class D# {\n  run({ a }: { a: number; b: P }, f = (x) => x): { c: number } {\n    go(1)\n    if (x) { return }\n  }\n}\n", [("D#", 1, 6), ("D#.run", 2, 5)]),
        ("const s# = 'function no() {' + \"class No {\" + `interface No {`;\n", []),
        ("@tag('}')\nclass C# extends Base<{ a: 1 }> {\n  static async run<T>(x: T): Promise<T> {\n    if (x) { return x }\n    return `${x}\n}`;\n  }\n}\n", [("C#", 1, 8), ("C#.run", 3, 7)]),
    ],
    "rs": [
        ("pub struct P#<'a> { s: &'a str }\nimpl<'a> P#<'a> {\n  fn get(&self) -> &'a str { self.s }\n}\n", [("P#", 1, 1), ("impl P#", 2, 4), ("P#::get", 3, 3)]),
        ("impl<'a, T: Into<Option<String>> + Fn(u8) -> u8> Show<'a> for Q#<'a> {\n  fn c(&self) -> char { '{' }\n  fn d(&self) -> &'static str { r#\"}\"{\"# }\n  fn e(&self) -> u8 { b'}' + b'\\'' }\n}\n".replace("r#", "r\0").replace("\"#", "\"\0"), [("impl Q#", 1, 5), ("Q#::c", 2, 2), ("Q#::d", 3, 3), ("Q#::e", 4, 4)]),
        ("/* a /* b { */ fn no() { */\nfn last#<'a>(x: &'a str) -> &'a str {\n  \"{\n\"\n}\n", [("last#", 2, 5)]),
        ("impl From<&'static str> for a::R#<u8> {\n  fn from(s: &str) -> Self { '\\u{7b}' }\n}\n", [("impl R#", 1, 3), ("R#::from", 2, 2)]),
        ("pub async fn w#<F>(x: [u8; 3]) -> [u8; 2]\nwhere\n    F: Fn(u8) -> Vec<u8>,\n{\n  [0; 2]\n}\n", [("w#", 1, 6)]),
        ("impl<T> Show for &'a mut S# {}\ntrait U# {\n  fn promised(&self);\n}\n", [("impl S#", 1, 1), ("U#", 2, 4)]),
    ],
    "go": [
        ("func A#() string { return `\\` }\n", [("A#", 1, 1)]),
        ("func I#(x interface{}, f func() struct{ a int }) interface{} {\n\treturn x\n}\n", [("I#", 1, 3)]),
        ("func B#() rune {\n\treturn '{'\n}\n", [("B#", 1, 3)]),
        ("type S# struct {\n\tx string `json:\"{\"`\n}\n\nfunc (s *S#) Get() string { return \"}\\\"{\" }\n", [("S#", 1, 3), ("S#.Get", 5, 5)]),
        ("// don't {\nconst c# = `\nfunc no() {\n`\n", []),
    ],
}


@pytest.mark.parametrize("language", SHAPES)
@pytest.mark.parametrize("seed", range(8))
def test_spans_in_planted_text_of_many_shapes(language, seed):
    rng = random.Random(seed)
    text, want, lines = "", [], 0
    for n in range(40):
        piece, made = rng.choice(SHAPES[language])
        text += piece.replace("#", str(n)).replace("\0", "#")
        want += [(name.replace("#", str(n)), first + lines, last + lines) for name, first, last in made]
        lines += piece.count("\n")
    assert [(x["qualified_name"], x["start_line"], x["end_line"]) for x in brace_symbols(text, language)] == want
    plain = without_literals(text, language)
    assert len(plain) == len(text) and [i for i, x in enumerate(plain) if x == "\n"] == [i for i, x in enumerate(text) if x == "\n"]


def test_calls_in_template_strings_and_none_in_patterns():
    said = typescript_uses("const a = `x ${ call(b) } ${`no() ${other(1)}`} not(2)`;\nconst r = /fake(1)/.test(x) / two(3) / 4;\n")
    assert [(n, line) for use, n, line in said if use == "call"] == [("call", 1), ("other", 1), ("test", 2), ("two", 2)]


@pytest.mark.parametrize("text", ["`", "a ${", "`${", "`${`${", "/*", "'", '"', "/", "/[", "}", "`${}}", "x = /(/", "\\", 'r#"', "'a"])
def test_what_is_never_closed(text):
    for language in SHAPES:
        for around in (text, f"function f() {{\n{text}\n}}\n"):
            assert len(without_literals(around, language)) == len(around)
            brace_symbols(around, language)
    typescript_uses(text)


@pytest.mark.parametrize("scan", [typescript_uses, lambda t: brace_symbols(t, "ts"), lambda t: skeleton_of("a.ts", t)])
def test_scanners_grow_with_the_text(scan):
    unit = "export class A { run(x: number) { return call(x) + other.call(x) } }\nfunction f(a: B) { return new C(a) }\n"
    took = []
    for n in (250, 2000):
        began = time.perf_counter()
        scan(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_index_policies(spark, tmp_path):
    from tessera.sources.code import index_edges, read_symbol_index

    there = tmp_path / "index.json"
    assert read_symbol_index(spark, str(there))[0] == "SKIPPED_NOT_FOUND" and read_symbol_index(spark, str(there), "DISABLED")[0] == "DISABLED"
    with pytest.raises(FileNotFoundError):
        read_symbol_index(spark, str(there), "CI_PRECISE")
    there.write_text('{"metadata": {}, "documents": [{"relative_path": "src\\\\a.ts", "symbols": [{"symbol": "npm p 1 `b.ts`/B#", "relationships": [{"symbol": "x/C#", "isImplementation": true}, {"symbol": "x/run()", "isTypeDefinition": true}]}],\n "occurrences": [{"symbol": "npm p 1 b/B#", "symbolRoles": 8, "range": [1, 2, 1, 3]}, {"symbol": "x/C#", "symbolRoles": 1}, {"symbol": "a.ts", "symbolRoles": 2}]}, {"relative_path": "no.ts"}]}')
    units = spark.createDataFrame([(1, "src/a.ts", "a.ts"), (2, None, "B"), (3, None, "C"), (4, None, "run"), (5, None, None)], "unit_id long, path string, title string")
    status, index = read_symbol_index(spark, str(there), "CI_PRECISE")
    assert status == "INGESTED" and sorted(map(tuple, index_edges(index, units).collect())) == [(1, 2, "REFERENCES", 0.98), (2, 3, "IMPLEMENTS", 1.0), (2, 4, "TYPE_USES", 1.0)]
    there.write_text('{"documents": [')
    assert index_edges(read_symbol_index(spark, str(there))[1], units).collect() == []
    with pytest.raises(ValueError):
        read_symbol_index(spark, str(there), "CI_PRECISE")
