"""Symbols, skeletons and units from source text, by language."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import settled

#: A symbol's columns beside its file: spans by line and by byte of the UTF-8 text (end exclusive), the head's text, the class it is in,
#: and what makes a skeleton of it unsafe.
COLUMNS = ["kind", "name", "qualified_name", "start_line", "end_line", "start_byte", "end_byte", "signature", "parent", "has_decorators", "has_top_level_code", "is_module_init", "unsafe"]
SYMBOLS = "unit_id long, kind string, name string, qualified_name string, start_line int, end_line int, start_byte int, end_byte int, signature string, parent string, has_decorators boolean, has_top_level_code boolean, is_module_init boolean, unsafe boolean"


def _symbol(kind, name, qualified, lines, span, signature="", parent=None, decorated=False, loose=False, init=False) -> dict:
    return dict(zip(COLUMNS, (kind, name, qualified, *lines, *span, signature, parent, decorated, loose, init, decorated), strict=True))


def _indented_symbols(text: str) -> list[dict]:
    """Python that doesn't parse: heads at the margin, each up to the next line at the margin."""
    lines, starts, out = text.split("\n"), [0], []
    for line in lines:
        starts.append(starts[-1] + len(line.encode()) + 1)
    for i, line in enumerate(lines):
        if m := re.match(r"(class|(?:async )?def) +(\w+)", line):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and not lines[j][0].isspace()), len(lines))
            out.append(_symbol("class" if m[1] == "class" else "function", m[2], m[2], (i + 1, end), (starts[i], min(starts[end], len(text.encode()))), line.strip()))
    return out


def python_symbols(text: str, path: str = "file.py") -> list[dict]:
    """Top-level functions and classes and their methods; a decorated symbol begins at its first decorator. Text that doesn't parse: by indentation."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _indented_symbols(text)
    lines, starts = text.splitlines(keepends=True), [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()))
    defines = (ast.FunctionDef, ast.AsyncFunctionDef)
    texts = lambda x: isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)
    loose = any(not isinstance(x, (*defines, ast.ClassDef, ast.Import, ast.ImportFrom)) and not texts(x) for x in tree.body)
    init = path.endswith("__init__.py")

    def head(at: int) -> str:
        said = []
        for line in lines[at - 1 : at + 10]:
            said.append(line.strip())
            if ":" in line:
                break
        return " ".join(said)

    def symbol(kind: str, x, parent: str | None) -> dict:
        first = min([d.lineno for d in x.decorator_list], default=x.lineno)
        name = f"{parent}.{x.name}" if parent else x.name
        return _symbol(kind, x.name, name, (first, x.end_lineno), (starts[first - 1], starts[x.end_lineno - 1] + x.end_col_offset), head(x.lineno), parent, bool(x.decorator_list), loose and parent is None, init)

    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append(symbol("class", node, None))
            out += [symbol("method", x, node.name) for x in node.body if isinstance(x, defines)]
        elif isinstance(node, defines):
            out.append(symbol("function", node, None))
    return out


#: What ends a head or counts in it: arrows, brackets of all kinds, a semicolon, or a line that begins with the next declaration.
_IN_HEAD = re.compile(r"->|=>|[()\[\]<>{};]|\n(?P<indent>[ \t]*)(?=(?:export|declare|abstract|class|interface|enum|type|function|async|const|let|var|import|func|fn|pub|impl|struct|trait|macro_rules)\b|@|#\[)")
#: What stands before a brace that opens a type, by language.
_BEFORE_TYPE = {"ts": re.compile(r"[:|&=]\s*\Z"), "go": re.compile(r"\b(?:interface|struct)\s*\Z"), "rs": re.compile(r"(?!)")}


class Places:
    """Lines, bytes and braces of a text, each found in one pass; `plain` has its strings and comments blanked."""

    def __init__(self, text: str, plain: str, language: str):
        self.plain, self.before_type, self.size, self.lines = plain, _BEFORE_TYPE[language].search, len(text), [m.end() for m in re.finditer("\n", text)]
        self.wide = None if text.isascii() else list(accumulate((len(x.encode()) for x in text), initial=0))
        self.closing, held = {}, []
        for m in re.finditer("[{}]", plain):
            if m.group() == "{":
                held.append(m.start())
            elif held:
                self.closing[held.pop()] = m.end()

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at) + 1

    def byte(self, at: int) -> int:
        return at if self.wide is None else self.wide[at]

    def closed(self, brace: int) -> int:
        """The place after the brace that closes this one; the text's end where none does."""
        return self.closing.get(brace, self.size)

    def body(self, at: int, bodiless: bool = False) -> tuple[int, int]:
        """The brace that opens the body of a head from `at` on (-1: it has none) and the place after the whole. Braces in brackets,
        and those of types, are none."""
        first, deep, angles = at, 0, 0
        while m := _IN_HEAD.search(self.plain, at):
            mark, at = m.group(), m.end()
            if mark[0] == "\n":
                if not (deep or angles) or not m["indent"]:
                    end = m.start()
                    while end > first and self.plain[end - 1].isspace():
                        end -= 1
                    return -1, end
            elif mark in "([":
                deep += 1
            elif mark in ")]":
                deep -= 1
                if deep < 0:
                    break
            elif mark in "<>" and not deep:
                angles = max(0, angles + (1 if mark == "<" else -1))
            elif mark == "{":
                if not (deep or angles or bodiless or self.before_type(self.plain, max(first, m.start() - 40), m.start())):
                    return m.start(), self.closed(m.start())
                at = self.closed(m.start())
            elif mark == "}" or (mark == ";" and not deep):
                return -1, m.end() - (mark == "}")
        return -1, first


_DECORATED = r"^[ \t]*(?P<deco>(?:@[\w.]+(?:\([^()]*\))?\s*)*)"
_ATTRIBUTES = r"^[ \t]*(?P<deco>(?:#\[[^\]]*\]\s*)*)"
#: Generic parameters in angle brackets up to three deep, arrows among them.
_GENERIC = r"(?:<(?:->|[^<>{}]|<(?:->|[^<>{}]|<(?:->|[^<>{}])*+>)*+>)*+>)?"
#: Parameters in brackets up to three deep, with the braces of types, patterns and empty values.
_PARAMETERS = r"\((?:[^(){};]|\{[^{}]*\}|\((?:[^(){};]|\{[^{}]*\}|\((?:[^(){};])*+\))*+\))*+\)"
_WORDS = "if|for|while|switch|catch|return|function|constructor|new|do|else|try|typeof|await|throw"
#: Heads of brace languages' symbols: kind and pattern, the name is the group `name`, decorators before it the group `deco`.
HEADS = {
    "ts": [
        ("function", _DECORATED + r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"), ("class", _DECORATED + r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        ("interface", r"^[ \t]*(?P<deco>)(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)"), ("enum", r"^[ \t]*(?P<deco>)(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"),
        ("alias", r"^[ \t]*(?P<deco>)(?:export\s+)?(?:declare\s+)?type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*="),
        ("method", _DECORATED + rf"(?:(?:public|private|protected|static|async|abstract|override|readonly|get|set)\s+)*\*?(?P<name>(?!(?:{_WORDS})\b)#?[\w$]+)\s*(?:<[^(]*>)?" + _PARAMETERS + r"\s*(?::\s*\{[^{}]*\}\s*(?=\{)|:[^;{}=]*)?\{"),
    ],
    "go": [("method", r"^(?P<deco>)func\s*\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)"), ("function", r"^(?P<deco>)func\s+(?P<name>\w+)"), ("class", r"^(?P<deco>)type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct"), ("interface", r"^(?P<deco>)type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface")],
    "rs": [("function", _ATTRIBUTES + r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)"), ("class", _ATTRIBUTES + r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", _ATTRIBUTES + r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"),
           ("interface", _ATTRIBUTES + r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"), ("impl", _ATTRIBUTES + r"impl\b" + _GENERIC + r"\s*(?:[^{;]*?\s+for\s+(?!<))?(?:&\s*(?:'\w+\s+)?)?(?:mut\s+|dyn\s+)*(?:\w+\s*::\s*)*(?P<name>\w+)[^{;]*(?=\{)"), ("macro", _ATTRIBUTES + r"macro_rules!\s*(?P<name>\w+)")],
}
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "go": "go", "rs": "rs", "py": "py"}
_BODIED = ("function", "method", "class", "interface", "impl")


def brace_symbols(text: str, language: str) -> list[dict]:
    """Symbols of a brace language in order. A TypeScript method is one inside a class, and is named by it; a Go method is named by its receiver's
    type, a Rust one by the type of the impl that it stands in; what stands inside a Rust function or macro is none."""
    found = []
    plain = without_literals(text, language)
    at = Places(text, plain, language)
    for kind, pattern in HEADS[language]:
        for m in re.finditer(pattern, plain, re.MULTILINE):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            brace, end = (m.end() - 1, at.closed(m.end() - 1)) if m.group().endswith("{") else at.body(m.end(), kind == "alias")
            bodied = brace >= 0
            if language == "rs" and kind == "function" and not bodied:
                continue  # a trait's promise
            name, begins = m["name"], m.end("deco")
            head = f"macro_rules! {name}" if kind == "macro" else text[begins if language == "rs" else start : brace].strip() if bodied and kind in _BODIED else f"{ {'alias': 'type'}.get(kind, kind)} {name}" if kind in ("alias", "enum", "class", "interface") else text[start:end].strip()
            found.append((start, end, kind, name, head, bool(m["deco"].strip()), m.groupdict().get("owner")))
    out, around = [], []
    for start, end, kind, name, head, decorated, owner in sorted(found, key=lambda x: (x[0], -x[1])):
        while around and around[-1][0] <= start:
            around.pop()
        holder = around[-1] if around else (0, None, None)
        parent = owner or (next((x[2] for x in reversed(around) if x[1] == "class"), None) if language == "ts" else holder[2] if holder[1] == "impl" else None)
        if (kind == "method" and language == "ts" and parent is None) or (language == "rs" and holder[1] in ("function", "macro")):
            continue
        around.append((end, kind, name))
        shown = "method" if kind == "function" and language == "rs" and parent else "function" if kind == "macro" else kind
        qualified = f"impl {name}" if kind == "impl" else f"{parent}{'::' if language == 'rs' else '.'}{name}" if shown == "method" and parent else name
        out.append(_symbol(shown, name, qualified, (at.line(start), at.line(max(start, end - 1))), (at.byte(start), at.byte(end)), head, parent, decorated or kind == "macro"))
    return out


#: What a text's plain form has to tell apart, by language: comments, strings, letters in quotes (a lone quote is a lifetime in Rust), raw strings,
#: and in TypeScript the marks of template strings, the slash that may begin a pattern, and the braces that may end a template's expression.
_STRING = r'"(?:\\.|[^"\\\n])*"'
_LITERALS = {
    "ts": re.compile(rf"""//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|{_STRING}|'(?:\\.|[^'\\\n])*'|[`{{}}/]"""),
    "go": re.compile(rf"""//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|{_STRING}|`[^`]*(?:`|\Z)|'(?:\\[^\n][^'\n]*|[^'\\\n])'"""),
    "rs": re.compile(r"""//[^\n]*|/\*|\bb?r(#*)"(?s:.*?)"\1|"(?:\\(?s:.)|[^"\\])*"|'(?:\\[^\n][^'\n]*|[^'\\\n])'"""),
}
_REMARK = re.compile(r"/\*|\*/")
_IN_TEMPLATE = re.compile(r"\\(?s:.)|`|\$\{")
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield))\Z")


def without_literals(text: str, language: str = "ts") -> str:
    """text with the inside of strings, patterns and comments blanked, letter by letter, so that places stay; the expressions in template strings
    stay too. One pass; what isn't closed ends with the text (strings on one line: is none)."""
    out, at, said = [], 0, ""
    depths: list[int] = []  # braces open in each template expression around
    next_literal = _LITERALS[language].search

    def hide(to: int, quoted: bool = False) -> None:
        """Blanks up to `to`; the outer two letters stay if they are quotes."""
        nonlocal at, said
        whole = text[at:to]
        out.append(whole[0] + re.sub(r"[^\n]", " ", whole[1:-1]) + whole[-1] if quoted else re.sub(r"[^\n]", " ", whole))
        at, said = to, '"' if quoted else said

    def show(to: int) -> None:
        """Leaves the text up to `to` as it is."""
        nonlocal at, said
        if to > at:
            out.append(text[at:to])
            said = text[max(at, to - 200) : to].rstrip()[-12:] or said
            at = to

    def template() -> None:
        """Blanks a template string from `at` up to its end, or to its next expression, which is left open."""
        while m := _IN_TEMPLATE.search(text, at):
            if m.group() == "`":
                hide(m.start())
                return show(m.end())
            hide(m.end() - (m.group() == "${"))
            if m.group() == "${":
                depths.append(0)
                return show(m.end())
        hide(len(text))

    while m := next_literal(text, at):
        mark = m.group()
        show(m.start())
        if mark == "/*" and language == "rs":  # comments in comments
            deep, to = 1, m.end()
            while deep and (x := _REMARK.search(text, to)):
                deep, to = deep + (1 if x.group() == "/*" else -1), x.end()
            hide(to if not deep else len(text))
        elif mark.startswith(("//", "/*")):
            hide(m.end())
        elif mark == "/":
            found = _PATTERN.match(text, at) if _BEFORE_PATTERN.search(said) else None
            hide(found.end(), quoted=True) if found else show(m.end())
        elif mark == "`":
            show(m.end())
            template()
        elif mark in ("{", "}"):
            show(m.end())
            if depths and mark == "{":
                depths[-1] += 1
            elif depths and depths[-1]:
                depths[-1] -= 1
            elif depths:
                depths.pop()
                template()
        else:
            hide(m.end(), quoted=mark[0] in "\"'`" and mark[-1] == mark[0] and len(mark) > 1)
    show(len(text))
    return "".join(out)


def symbols_of(path: str, text: str) -> list[dict]:
    """Symbols by the path's extension; none for other files."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1])
    return [] if language is None else python_symbols(text, path) if language == "py" else brace_symbols(text, language)


def symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS rows of files (unit_id, path, content)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *s.values()) for i, p, t in zip(f["unit_id"], f["path"], f["content"], strict=True) for s in symbols_of(p, t or "")]
            yield pd.DataFrame(rows, columns=["unit_id", *COLUMNS])

    return files.select("unit_id", "path", "content").mapInPandas(scan, SYMBOLS)


USES = "unit_id long, use string, name string, line int"


_CALL = re.compile(r"(\bfunction\s*\*?\s*)?([\w$]+)\s*(?:<[\w$, .\[\]]*>)?\(")
_HEAD_FOLLOWS = re.compile(r"[^;{}()]*\)\s*(?::[^;{}=]*)?\{")
_ENDS_ARGUMENT = re.compile(r"\s*[,)]")
_NO_CALL = re.compile(_WORDS + "|super|import")


def typescript_uses(text: str) -> list[tuple[str, str, int]]:
    """(use, name, line) of what a TypeScript file says of others: import (the specifier), implements and extends (class and base, by a space),
    call, type and identifier."""
    plain, out = without_literals(text), []
    breaks = [m.end() for m in re.finditer("\n", plain)]
    line = lambda at: bisect_right(breaks, at) + 1

    def before(at: int) -> int:
        """The place after the last letter before `at` that isn't blank."""
        while at > 0 and plain[at - 1].isspace():
            at -= 1
        return at

    for m in re.finditer(r"\b(?:import|export)\b[^;'\"(={}]*(?:\{[^;'\"(={}]*\}[^;'\"(={}]*?)?\bfrom\s*(['\"])|\bimport\s*(['\"])", plain):
        quote = m.end() - 1
        out.append(("import", text[quote + 1 : text.index(text[quote], quote + 1)], line(m.start())))
    taken = set()  # places of identifiers that are something else
    for m in re.finditer(r"\b(class|interface)\s+([\w$]+)([^{]*)\{", plain):
        for part, use in (("extends", "extends"), ("implements", "implements")):
            if found := re.search(rf"\b{part}\s+([^{{]*?)(?=\b(?:extends|implements)\b|$)", m[3]):
                bare = re.sub(r"<[^<>]*>", "", found[1])
                out += [(use, f"{m[2]} {x.strip()}", line(m.start())) for x in bare.split(",") if x.strip()]
    for m in _CALL.finditer(plain):
        if m[1] or _NO_CALL.fullmatch(m[2]) or m[2][0].isdigit():
            continue
        end = before(m.start(2))
        dotted = plain.startswith(".", end - 1) if end else False
        if not dotted and not plain.endswith("new", 0, end) and _HEAD_FOLLOWS.match(plain, m.end()):
            continue  # a method's head
        out.append(("call", m[2], line(m.start(2))))
        if not dotted:
            taken.add(m.start(2))
    for m in re.finditer(r"(?:[:|&]|\bas|\btype\s+[\w$]+\s*=|<)\s*([A-Z][\w$]*)", plain):
        out.append(("type", m[1], line(m.start(1))))
        taken.add(m.start(1))
    for m in re.finditer(r"(?<![\w$])[A-Za-z_$][\w$]*", plain):
        end = before(m.start())
        argument = end and plain[end - 1] in "(," and _ENDS_ARGUMENT.match(plain, m.end())
        if m.start() not in taken and not argument:
            out.append(("identifier", m.group(), line(m.start())))
    return out


def uses(files: DataFrame) -> DataFrame:
    """USES rows of the TypeScript and JavaScript files among files (unit_id, path, content); a name once for each use and line."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *u) for i, p, t in zip(f["unit_id"], f["path"], f["content"], strict=True) if LANGUAGES.get(p.rsplit(".", 1)[-1]) == "ts" for u in dict.fromkeys(typescript_uses(t or ""))]
            yield pd.DataFrame(rows, columns=["unit_id", "use", "name", "line"])

    return files.select("unit_id", "path", "content").mapInPandas(scan, USES)


class _Bodiless(ast.NodeTransformer):
    def visit_FunctionDef(self, node):
        doc = ast.get_docstring(node)
        node.body = [ast.Expr(ast.Constant(doc))] * (doc is not None) + [ast.Expr(ast.Constant(...))]
        return node

    visit_AsyncFunctionDef = visit_FunctionDef


def skeleton_of(path: str, text: str) -> str:
    """Text without the bodies of its functions; other files as they are."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1])
    if language == "py":
        try:
            return ast.unparse(_Bodiless().visit(ast.parse(text)))
        except (SyntaxError, ValueError, RecursionError):
            return text
    if language is None:
        return text
    out, at, plain = [], 0, without_literals(text, language)
    places = Places(text, plain, language)
    heads = [m for kind, p in HEADS[language] if kind in ("function", "method") for m in re.finditer(p, plain, re.MULTILINE)]
    for m in sorted(heads, key=lambda m: m.start()):
        brace = m.end() - 1 if m.group().endswith("{") else places.body(m.end())[0]
        if m.start() < at or brace < 0:
            continue
        out.append(text[at : brace + 1] + " ... }")
        at = places.closed(brace)
    return "".join(out) + text[at:]


def skeletons(files: DataFrame) -> DataFrame:
    """unit_id, skeleton of files (unit_id, path, content)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"unit_id": f["unit_id"], "skeleton": [skeleton_of(p, t or "") for p, t in zip(f["path"], f["content"], strict=True)]})

    return files.select("unit_id", "path", "content").mapInPandas(scan, "unit_id long, skeleton string")


#: Folders and endings of files that are never indexed.
EXCLUDED_FOLDERS = ["node_modules", ".git", "dist", "build", "benchmarks", ".next", ".venv", "__pycache__"]
EXCLUDED_ENDINGS = [".min.js", ".min.css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2"]


def indexed(path: Column) -> Column:
    """Whether a relative path is indexed: no excluded folder or ending, and no part that begins with a dot."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ends = reduce(lambda x, y: x | y, [path.endswith(e) for e in EXCLUDED_ENDINGS])
    return ~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_FOLDERS))) & ~ends & ~F.exists(parts, lambda p: p.startswith("."))


#: Rows of a listing, and bytes of contents, that a task hands on at once.
LISTED, HELD_BYTES = 8192, 16 << 20


def _open_folder(spark, folder: str) -> tuple[pafs.FileSystem | None, str]:
    """The file system of a folder, and its path there; None where Arrow doesn't know the system or can't open it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    path = uri.getPath().rstrip("/")
    if uri.getScheme() == "file":
        return pafs.LocalFileSystem(), path
    try:
        system, found = pafs.FileSystem.from_uri(uri.toString())
        return system, found.rstrip("/")
    except (pa.ArrowException, OSError):
        return None, path


def listed_files(spark, system: pafs.FileSystem, root: str) -> DataFrame:
    """path (relative to root) and size of the files below a folder but for those in folders that are never indexed.

    A round lists all folders of a depth, each in the task that it is dealt to, and writes what they hold: the driver holds neither files nor folders.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                held = system.get_file_info(pafs.FileSelector(f"{root}/{folder}"))
                for start in range(0, len(held), LISTED):
                    own = [x for x in held[start : start + LISTED] if x.type in (pafs.FileType.File, pafs.FileType.Directory)]
                    rows = {"path": [f"{folder}/{x.base_name}".lstrip("/") for x in own], "size": [x.size or 0 for x in own], "folder": [not x.is_file for x in own]}
                    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())]))

    tasks, files = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    folders = spark.createDataFrame([("",)], "path string")
    while files is None or not folders.isEmpty():
        found = settled(folders.repartition(tasks, "path").mapInArrow(listed, "path string, size long, folder boolean"), "listing")
        own = found.filter("not folder").select("path", "size")
        files = own if files is None else files.unionByName(own)
        # A folder is kept as a file within it would be.
        folders = found.filter("folder").filter(indexed(F.concat("path", F.lit("/x")))).select("path")
    return files


def repository_files(spark, folder: str, glob: str = "*") -> DataFrame:
    """path (relative to folder), content and size of the indexed files below a folder, and `readable`: whether the content is UTF-8.

    Files are listed and read by tasks; only where Arrow can't open the file system does Spark list them, on the driver, but for names that begin with an underscore.
    """
    system, root = _open_folder(spark, folder)
    if system is None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
        at = F.locate(root + "/", F.col("path"))
        rows = rows.select(F.substring(F.col("path"), at + len(root) + 1, F.length("path")).alias("path"), "content", F.col("length").alias("size")).filter(indexed(F.col("path")))
    else:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def handed(batch: pa.RecordBatch, start: int, contents: list[bytes]) -> pa.RecordBatch:
                part = batch.slice(start, len(contents))
                return pa.RecordBatch.from_arrays([part.column("path"), pa.array(contents, pa.binary()), part.column("size")], ["path", "content", "size"])

            for batch in batches:
                start, contents, held = 0, [], 0
                for path in batch.column("path").to_pylist():
                    with system.open_input_stream(f"{root}/{path}", compression=None) as file:
                        contents.append(file.read())
                    held += len(contents[-1])
                    if held >= HELD_BYTES:
                        yield handed(batch, start, contents)
                        start, contents, held = start + len(contents), [], 0
                if contents:
                    yield handed(batch, start, contents)

        name = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        named = F.element_at(F.split("path", "/"), -1).rlike(rf"(?s)\A(?:{name})\z")
        files = listed_files(spark, system, root).filter(indexed(F.col("path")) & named)
        rows = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(read, "path string, content binary, size long")
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "size", readable.alias("readable"))


def scan_quality(files: DataFrame) -> DataFrame:
    """scanned, errors, parser_coverage and confidence of a scan: unreadable files count as errors; both are rounded to 2 places."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("readable"))
    rows = files.agg(n.alias("scanned"), bad.alias("errors"))
    share = F.col("errors") / F.greatest(F.lit(1), F.col("scanned"))
    coverage = F.when(F.col("scanned") > 0, F.round((F.col("scanned") - F.col("errors")) / F.greatest(F.lit(1), F.col("scanned")), 2)).otherwise(1.0)
    return rows.select("scanned", "errors", coverage.alias("parser_coverage"), F.when(F.col("errors") == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.5), 1 - share), 2)).alias("confidence"))


def written_files(files: DataFrame, folder: str) -> int:
    """Writes each row (path, content as bytes) as a file below a folder that all tasks can reach; returns how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, root), made = pafs.FileSystem.from_uri(folder), set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                above = f"{root}/{path}".rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above)
                    made.add(above)
                with system.open_output_stream(f"{root}/{path}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    return files.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: What to do about a symbol index: never read it, read it if it is there, insist on it.
POLICIES = ["DISABLED", "BEST_EFFORT_LOCAL", "CI_PRECISE"]
INDEX = """documents array<struct<relative_path: string, symbols: array<struct<symbol: string, relationships: array<struct<symbol: string, isImplementation: boolean, isTypeDefinition: boolean>>>>,
  occurrences: array<struct<symbol: string, symbolRoles: int>>>>, _broken string"""


def read_symbol_index(spark, path: str, policy: str = "BEST_EFFORT_LOCAL") -> tuple[str, DataFrame]:
    """DISABLED, SKIPPED_NOT_FOUND or INGESTED, and the documents of the JSON index at a path (a file, or a folder of one for each repository).

    A missing index, or one that doesn't parse, is an error under CI_PRECISE; else what is missing or broken is left out.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = policy != "DISABLED" and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if not there:
        if policy == "CI_PRECISE":
            raise FileNotFoundError(f"a symbol index is required, and {path} isn't there")
        return "DISABLED" if policy == "DISABLED" else "SKIPPED_NOT_FOUND", spark.createDataFrame([], INDEX).drop("_broken")
    rows = spark.read.schema(INDEX).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    if policy == "CI_PRECISE":
        rows = settled(rows, "symbol-index")  # parsed once
        if rows.filter("_broken is not null").isEmpty():
            return "INGESTED", rows.drop("_broken")
        raise ValueError(f"a symbol index of {path} doesn't parse")
    return "INGESTED", rows.drop("_broken")


def base_symbol(symbol: Column) -> Column:
    """The last part of an index's symbol, without its marks."""
    parts = F.filter(F.split(symbol, r"[\s/#]+"), lambda x: x != "")
    return F.regexp_replace(F.try_element_at(parts, F.lit(-1)), "[#()]", "")


def index_edges(index: DataFrame, units: DataFrame) -> DataFrame:
    """src, dst, kind, confidence: from a document's file to the units that it refers to, and between units whose symbols are related.

    A symbol stands for the units whose title is its base name. Each document and pair of names meets them once. units: unit_id, path, title.
    """
    documents = index.select(F.explode("documents").alias("d")).select("d.*")
    named = units.select(F.col("unit_id").alias("dst"), F.col("title").alias("name")).filter("name is not null")
    files = units.filter("path is not null").select(F.col("unit_id").alias("src"), F.replace("path", F.lit("\\"), F.lit("/")).alias("file"))
    said = documents.select(F.replace("relative_path", F.lit("\\"), F.lit("/")).alias("file"), F.explode("occurrences").alias("o")).filter(F.col("o.symbolRoles").bitwiseAND(F.lit(1)) == 0)
    refers = said.select("file", base_symbol(F.col("o.symbol")).alias("name")).distinct().join(files, "file").join(named, "name").filter("src <> dst")
    pairs = documents.select(F.explode("symbols").alias("s")).select(base_symbol(F.col("s.symbol")).alias("source"), F.explode("s.relationships").alias("r"))
    kind = F.when(F.col("r.isImplementation"), "IMPLEMENTS").when(F.col("r.isTypeDefinition"), "TYPE_USES").otherwise("REFERENCES")
    pairs = pairs.select("source", base_symbol(F.col("r.symbol")).alias("name"), kind.alias("kind")).distinct()
    related = pairs.join(named.withColumnsRenamed({"dst": "src", "name": "source"}), "source").join(named, "name")
    edges = refers.select("src", "dst", F.lit("REFERENCES").alias("kind"), F.lit(0.98).alias("confidence")).unionByName(related.select("src", "dst", "kind", F.lit(1.0).alias("confidence")))
    return edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))
