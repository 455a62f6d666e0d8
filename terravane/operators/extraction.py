"""Symbols and sections from source texts: Markdown in DataFrame operations, Python by its syntax tree, other languages by tables."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checkpoints import cut


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ordinal, level, title, start_line, end_line, body of every heading; a body ends at the next heading. Fences hide headings."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    w = W.partitionBy("id").orderBy("n")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(w))
    head = (F.col("fences") % 2 == 0) & ~fence & F.col("line").rlike(r"^#{1,6}[ \t]+\S")
    lines = lines.withColumn("head", head).withColumn("ordinal", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(w)).where("ordinal > 0")
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "line")))), lambda x: x["line"]), "\n"))
    title = F.max(F.when(F.col("head"), F.col("line")))
    g = lines.groupBy("id", "ordinal").agg(title.alias("t"), (F.min("n") + 1).alias("start_line"), (F.max("n") + 1).alias("end_line"), body.alias("body"))
    return g.select("id", "ordinal", F.char_length(F.regexp_extract("t", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("t", r"^#+[ \t]+|[ \t]+#+[ \t]*$", "")).alias("title"), "start_line", "end_line", "body")


SYMBOL = "path string, kind string, name string, qualified_name string, parent string, start_line int, end_line int, signature string, docstring string"
REFERENCE = "path string, owner string, type string, name string, qualifier string, line int"

_WORDS = r"[A-Za-z_][A-Za-z0-9_]*"
#: For each family of languages, kinds and the pattern of a line that declares one; the last group is the name.
DECLARATIONS = {
    "javascript typescript tsx jsx astro": (
        ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_WORDS})"),
        ("interface", rf"^\s*(?:export\s+)?interface\s+({_WORDS})"),
        ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_WORDS})"),
        ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_WORDS})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_WORDS})\s*=>"),
    ),
    "java csharp kotlin swift scala dart": (
        ("interface", rf"^\s*(?:public\s+|private\s+|internal\s+)*(?:interface|protocol|trait)\s+({_WORDS})"),
        ("class", rf"^\s*(?:public\s+|private\s+|protected\s+|internal\s+|open\s+|data\s+|abstract\s+|final\s+|static\s+|sealed\s+)*(?:class|struct|enum|object|record)\s+({_WORDS})"),
        ("function", rf"^\s*(?:public\s+|private\s+|internal\s+|override\s+|open\s+|static\s+)*(?:fun|func|def)\s+({_WORDS})"),
        ("method", rf"^\s+(?:(?:public|private|protected|static|final|override|virtual|async)\s+)+[\w<>\[\],.? ]+\s+({_WORDS})\s*\([^;]*$"),
    ),
    "c cpp objective_c": (
        ("class", rf"^\s*(?:class|struct|union|enum|@interface)\s+({_WORDS})\s*[:{{]"),
        ("function", rf"^(?!\s*(?:return|else|if|while|for|switch)\b)[\w*&<>:\s]+?\b({_WORDS})\s*\([^;]*\)\s*(?:const)?\s*\{{"),
    ),
    "rust": (
        ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+({_WORDS})"),
        ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+({_WORDS})"),
        ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+({_WORDS})"),
    ),
    "go": (
        ("method", rf"^func\s+\([^)]*\)\s*({_WORDS})"),
        ("function", rf"^func\s+({_WORDS})"),
        ("interface", rf"^type\s+({_WORDS})\s+interface"),
        ("class", rf"^type\s+({_WORDS})\s+struct"),
    ),
}


def _python(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    symbols, refs = [], []

    def dotted(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
            return f"{head}.{node.attr}"
        return None

    def refer(owner, kind, node) -> None:
        if name := dotted(node):
            head, _, leaf = name.rpartition(".")
            refs.append((path, owner, kind, leaf, head or None, getattr(node, "lineno", 0), None))

    def annotated(owner, kind, node) -> None:
        """Every name in an annotation: in subscripts, in unions, and in quotes."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                quoted = ast.parse(node.value.strip(), mode="eval").body
            except (SyntaxError, ValueError, RecursionError):
                return
            annotated(owner, kind, ast.copy_location(quoted, node) if isinstance(quoted, ast.Name) else quoted)
        elif dotted(node):
            refer(owner, kind, node)
        elif node is not None:
            for x in ast.iter_child_nodes(node):
                annotated(owner, kind, x)

    def calls(node, owner) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call) and (name := dotted(x.func)):
                refer(owner, "constructs" if name.rpartition(".")[2][:1].isupper() else "calls", x.func)
            calls(x, owner)

    def walk(body, parent: str | None, inside_class: bool, counted: bool = False) -> None:
        for node in body:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                module = "." * node.level + (node.module or "") if isinstance(node, ast.ImportFrom) else None
                for a in node.names:
                    refs.append((path, parent, "imports", a.name, module, node.lineno, a.asname or a.name))
                    if module is None and not a.asname and "." in a.name:  # binds the first part, too
                        refs.append((path, parent, "imports", a.name.split(".")[0], None, node.lineno, a.name.split(".")[0]))
            elif isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                qn = f"{parent}.{node.name}" if parent else node.name
                is_class = isinstance(node, ast.ClassDef)
                test = node.name.startswith("test_") or node.name.endswith("_test") or "Test" in node.name
                kind = "class" if is_class and not test else "test" if test else "method" if inside_class else "function"
                sign = f"class {node.name}({', '.join(map(ast.unparse, node.bases))})" if is_class else f"def {node.name}({ast.unparse(node.args)})"
                symbols.append((path, kind, node.name, qn, parent, node.lineno, node.end_lineno, sign, ast.get_docstring(node)))
                for d in node.decorator_list:
                    refer(qn, "decorates", d.func if isinstance(d, ast.Call) else d)
                if is_class:
                    for b in node.bases:
                        refer(qn, "inherits", b.value if isinstance(b, ast.Subscript) else b)
                else:
                    if node.returns is not None:
                        annotated(qn, "returns_type", node.returns)
                    for a in [*node.args.posonlyargs, *node.args.args, node.args.vararg, *node.args.kwonlyargs, node.args.kwarg]:
                        if a is not None and a.annotation is not None:
                            annotated(qn, "accepts_type", a.annotation)
                walk(node.body, qn, is_class)
            else:
                if not counted:  # calls of a whole statement, those of statements inside it too
                    calls(node, parent)
                for field in ("body", "orelse", "finalbody", "handlers"):
                    walk(getattr(node, field, None) or [], parent, inside_class, True)

    walk(tree.body, None, False)
    return symbols, refs


def _by_table(path: str, text: str, rules) -> list[tuple]:
    """Declarations by line; a symbol ends before the next line of no deeper indent that declares one."""
    found, lines = [], text.split("\n")
    for n, line in enumerate(lines, 1):
        for kind, pattern in rules:
            if m := re.match(pattern, line):
                found.append((n, len(line) - len(line.lstrip()), kind, m.group(m.lastindex), line.strip()))
                break
    out, open_ = [], []
    for i, (n, indent, kind, name, sign) in enumerate(found):
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        parent = open_[-1][1] if open_ else None
        qn = f"{parent}.{name}" if parent else name
        kind = "method" if kind == "function" and open_ and open_[-1][2] in ("class", "interface") else kind
        end = next((m - 1 for m, k, *_ in found[i + 1 :] if k <= indent), len(lines))
        kind = "test" if re.match(r"(?i)(test|should)", name) or name.endswith("_test") or name.startswith("it_") else kind
        out.append((path, kind, name, qn, parent, n, end, sign, None))
        open_.append((indent, qn, kind))
    return out


def _rules(language: str):
    return next((r for names, r in DECLARATIONS.items() if language in names.split()), ())


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, text); text that does not parse has none."""
    return parse(files)[0]


#: Words before a parenthesis that are no calls.
NO_CALLS = frozenset("if for while switch catch return function typeof await new super else do in of with fn func def sizeof match when until unless and or not elif".split())
IMPORT = re.compile(r"""^\s*(?:import|export)\s+(?:type\s+)?(?:(?P<names>[\w*{}\s,$]+?)\s+from\s+)?["'](?P<module>[^"']+)["']|(?:(?:const|let|var)\s+(?P<bound>[\w{}\s,$:]+?)\s*=\s*)?require\(["'](?P<required>[^"']+)["']\)""")
PLAIN_IMPORT = re.compile(r"^\s*(?:import|use|using|#include)\s+(?:static\s+)?[<\"]?([\w.:/]+)")
BASES = re.compile(r"\b(extends|implements)\s+([\w.$<>,\s]+?)(?=\s*(?:\{|implements\b|$))")
CALL = re.compile(r"(?<![\w.$])(new\s+)?((?:[A-Za-z_$][\w$]*\s*(?:\.|::|->)\s*)*)([A-Za-z_$][\w$]*)\s*\(")


def _references_by_lines(path: str, text: str, language: str, rules) -> list[tuple]:
    """References of a text whose language has a table of declarations: imports with what they bind, bases, constructions and calls."""
    held = sorted((s[5], s[6], s[3]) for s in _by_table(path, text, rules))
    script = language in ("javascript", "typescript", "tsx", "jsx", "astro", "vue", "svelte")
    out, comment = [], False
    for n, line in enumerate(text.split("\n"), 1):
        if comment or line.lstrip().startswith(("//", "#!", "*", "/*")):
            comment = (comment or "/*" in line) and "*/" not in line
            continue
        code = re.sub(r"""(["'`])(?:\\\\.|(?!\1).)*\1""", lambda m: m.group(1) * 2, line) if not (script and IMPORT.search(line)) else line
        owner = next((q for s, e, q in reversed(held) if s <= n <= e), None)
        if script and (m := IMPORT.search(line)):
            module = (m.group("module") or m.group("required") or "").removeprefix("./")
            module = re.sub(r"\.(?:m?[jt]sx?)$", "", module).replace("../", "..").replace("/", ".")
            given = [re.split(r"\s+as\s+|\s*:\s*", x.strip()) for x in re.sub(r"[{}]", ",", m.group("names") or m.group("bound") or "").split(",") if x.strip()]
            for x in given or [[module.rsplit(".", 1)[-1]]]:
                whole = x[0] == "*" and len(x) > 1  # a name for the module
                out.append((path, owner, "imports", module if whole else x[0], None if whole else module, n, x[-1]))
            continue
        if not script and (m := PLAIN_IMPORT.match(line)):
            whole = re.sub(r"::|/", ".", m.group(1))
            out.append((path, owner, "imports", whole.rsplit(".", 1)[-1], whole, n, whole.rsplit(".", 1)[-1]))
            continue
        declared = any(re.match(p, line) for _, p in rules)
        for m in BASES.finditer(code):
            out += [(path, owner, "inherits" if m.group(1) == "extends" else "implements", x.split("<")[0].strip().rsplit(".", 1)[-1], None, n, None) for x in m.group(2).split(",") if x.strip()]
        for i, m in enumerate(CALL.finditer(code)):
            if m.group(3) in NO_CALLS or declared and i == 0 and "=>" not in code:
                continue  # the declaration itself
            qualifier = re.sub(r"\s|->|::", lambda x: "" if x.group().isspace() else ".", m.group(2)).rstrip(".") or None
            out.append((path, owner, "constructs" if m.group(1) or (script and m.group(3)[0].isupper() and m.group(1)) else "calls", m.group(3), qualifier, n, None))
    return out


def references(files: DataFrame) -> DataFrame:
    """References of files: imports, calls, constructions, bases; of Python also decorators and annotated types. owner is null at module level."""
    return parse(files)[1]


PARSED = "what int, " + SYMBOL + ", owner string, type string, qualifier string, alias string"
#: Declarations of Python that does not parse, by line.
HALF_PYTHON = (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)"))
#: Languages whose texts hold no declarations.
NO_CODE = frozenset("markdown text pdf json yaml toml xml html css".split())


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols and references of files (path, language, text), and paths of files that do not parse; each text is parsed once.

    The result is written, so all three read it. Of Python that does not parse the declarations' lines are taken; a
    language that has no table has those of generic_symbols().
    """
    spark = files.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)

    def run(frames):
        for f in frames:
            rows = []
            for path, lang, text in zip(f["path"], f["language"], f["text"]):
                text, rules = text or "", _rules(lang or "")
                found = _python(path, text) if lang == "python" else ([], []) if not rules else (_by_table(path, text, rules), _references_by_lines(path, text, lang or "", rules))
                if found is None:
                    found = _by_table(path, text, HALF_PYTHON), []
                    rows.append((2, path, *[None] * 12))
                rows += [(0, *s, None, None, None, None) for s in found[0]]
                rows += [(1, r[0], None, r[3], None, None, r[5], None, None, None, r[1], r[2], r[4], r[6]) for r in found[1]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    try:
        spark.conf.set(rows, "64")  # a file has five megabytes at most
        # Few files of a store, or small ones, would make few tasks.
        spread = files.select("path", "language", "text").repartition(4 * spark.sparkContext.defaultParallelism, "path")
        got = cut(spread.mapInPandas(run, PARSED), "parsed")
    finally:
        spark.conf.set(rows, before)
    names = [c.split()[0] for c in SYMBOL.split(", ")]
    known = [n for group in DECLARATIONS for n in group.split()]
    other = files.where(F.col("language").isNotNull() & ~F.col("language").isin("python", *known, *NO_CODE))
    none = F.lit(None).cast("string")
    other = generic_symbols(other).select("path", "kind", "name", F.col("name").alias("qualified_name"), none.alias("parent"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), none.alias("signature"), none.alias("docstring"))
    symbols = got.where("what = 0").select(*names).unionByName(other.dropDuplicates(["path", "qualified_name"]))
    return symbols, got.where("what = 1").select("path", "owner", "type", "name", "qualifier", F.col("start_line").alias("line"), "alias"), got.where("what = 2").select("path")


def module_doc(text: Column) -> Column:
    """What the first lines of a file say of it: a docstring's line, or the comment it starts with, of six lines at most; else null."""
    lines = F.transform(F.split(F.left(text, F.lit(2000)), r"\r\n|\r|\n"), lambda x: F.trim(x))
    first = F.get(lines, F.lit(0))
    quoted = F.when(F.startswith(first, F.lit('"""')), F.trim(F.trim(first, F.lit('"')))).when(F.startswith(first, F.lit("'''")), F.trim(F.trim(first, F.lit("'"))))
    mark = lambda x, *more: F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("/*")) | (F.startswith(x, F.lit("*")) if more else F.lit(False))
    rest = F.slice(lines, 2, 5)
    state = F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("got"))
    bare = lambda x: F.trim(F.regexp_replace(x, r"^[/*# ]+", ""))
    more = F.aggregate(rest, state, lambda s, x: F.struct((s["on"] & mark(x, 1)).alias("on"), F.when(s["on"] & mark(x, 1), F.concat(s["got"], F.array(bare(x)))).otherwise(s["got"]).alias("got")))["got"]
    said = F.trim(F.array_join(F.filter(F.concat(F.array(bare(first)), more), lambda x: x != ""), " "))
    out = F.when(F.startswith(first, F.lit('"""')) | F.startswith(first, F.lit("'''")), quoted).when(mark(first), said)
    return F.when(out != "", out)


def image_size(head: Column) -> Column:
    """struct(width, height) from the first bytes of a PNG, GIF or BMP; null for others."""
    h = F.hex(head)
    number = lambda at, size: F.conv(F.substring(h, 2 * at + 1, 2 * size), 16, 10).cast("long")
    little = lambda at, size: sum((F.conv(F.substring(h, 2 * (at + i) + 1, 2), 16, 10).cast("long") * (1 << 8 * i) for i in range(size)), F.lit(0).cast("long"))
    size = lambda w, x: F.struct(w.alias("width"), x.alias("height"))
    return (
        F.when(F.startswith(h, F.lit("89504E470D0A1A0A")), size(number(16, 4), number(20, 4)))
        .when(F.startswith(h, F.lit("474946383761")) | F.startswith(h, F.lit("474946383961")), size(little(6, 2), little(8, 2)))
        .when(F.startswith(h, F.lit("424D")), size(little(18, 4), little(22, 4)))
    )


def frontmatter(text: Column) -> Column:
    """struct(code, line) of a component file: what stands between its first two lines of three dashes, and the line it starts on."""
    lines = F.split(text, "\n")
    marks = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "---", i)), lambda i: i.isNotNull())
    first, second = F.get(marks, F.lit(0)), F.get(marks, F.lit(1))
    return F.when(second.isNotNull(), F.struct(F.array_join(F.slice(lines, first + 2, second - first - 1), "\n").alias("code"), (first + 2).alias("line")))


def generic_symbols(files: DataFrame, pattern: str = r"^\s*(?:export\s+|public\s+|private\s+|static\s+|pub\s+)*(class|struct|interface|trait|enum|function|func|fn|def|module|namespace|type)\s+([A-Za-z_][A-Za-z0-9_]*)") -> DataFrame:
    """path, kind, name, line of declarations of any language, by their keyword: the baseline where no table knows the language."""
    kinds = F.create_map(*[F.lit(x) for kv in {"class": "class", "struct": "class", "interface": "interface", "trait": "interface", "enum": "class", "function": "function", "func": "function", "fn": "function", "def": "function", "module": "module", "namespace": "module", "type": "class"}.items() for x in kv])
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.select("path", (F.col("n") + 1).alias("line"), F.regexp_extract("line", pattern, 1).alias("word"), F.regexp_extract("line", pattern, 2).alias("name")).where("name <> ''")
    return rows.select("path", kinds[F.col("word")].alias("kind"), "name", "line")
