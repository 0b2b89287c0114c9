"""Structural measurements of source code: functions and classes with complexity, nesting, vocabulary and size.

Python is parsed with the interpreter's own grammar, most other languages are scanned (operators/braces.py). A file that
doesn't parse falls back to what its text tells (operators/generic.py) and is marked.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from bisect import bisect_left
from collections.abc import Iterator
from math import log, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import MARKERS
from tessera.operators import braces
from tessera.operators.clones import fnv1a, token_arrays
from tessera.operators.generic import DIRECTIVE_PREFIX, measure_generic

# Tokens that count as neither operators nor operands, and the longest name shown.
NO_OPERATORS = frozenset([")", "]", "}", ",", ";", '"', "'", "`", "\n", ""])
NAME_LENGTH, MARKER_LENGTH = 60, 120

FUNCTION = pa.struct([
    ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("start_col", pa.int32()), ("end_line", pa.int32()), ("end_col", pa.int32()),
    ("params", pa.int32()), ("cyclomatic", pa.int32()), ("cognitive", pa.int32()), ("max_nesting", pa.int32()), ("sloc", pa.int32()),
    ("halstead", pa.struct([("distinct_operators", pa.int32()), ("distinct_operands", pa.int32()), ("total_operators", pa.int32()), ("total_operands", pa.int32()), ("volume", pa.float64()), ("difficulty", pa.float64()), ("effort", pa.float64())])),
    ("mi", pa.float64()),
])
CLASS = pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("start_col", pa.int32()), ("end_line", pa.int32()), ("methods", pa.int32())])
TODO = pa.struct([("line", pa.int32()), ("col", pa.int32()), ("text", pa.string())])
SUPPRESSION = pa.struct([("scope", pa.string()), ("line", pa.int32()), ("rules", pa.list_(pa.string()))])


def round2(x: float) -> float:
    return int(x * 100 + 0.5) / 100 if x >= 0 else -int(-x * 100 + 0.5) / 100


def halstead(operators: list[str], operands: list[str]) -> dict:
    n1, n2, t1, t2 = len(set(operators)), len(set(operands)), len(operators), len(operands)
    n = n1 + n2
    volume = (t1 + t2) * log2(n) if n > 1 else 0.0
    difficulty = n1 / 2 * t2 / n2 if n2 else 0.0
    return {"distinct_operators": n1, "distinct_operands": n2, "total_operators": t1, "total_operands": t2, "volume": round2(volume), "difficulty": round2(difficulty), "effort": round2(volume * difficulty)}


def maintainability(volume: float, cyclomatic: int, sloc: int) -> float:
    if volume <= 0 or sloc <= 0:
        return 100.0
    return round2(max(0.0, min(100.0, (171 - 5.2 * log(volume) - 0.23 * cyclomatic - 16.2 * log(sloc)) * 100 / 171)))


class Complexity:
    """Cyclomatic and cognitive complexity and the depth of one unit's own code; units inside it are left out."""

    def __init__(self, unit: ast.AST, elifs: set[int]):
        self.cyclomatic, self.cognitive, self.depth, self.elifs = 1, 0, 0, elifs
        self.children(unit, 0, 0)

    def children(self, node: ast.AST, level: int, depth: int) -> None:
        skip = getattr(node, "decorator_list", [])
        for child in ast.iter_child_nodes(node):
            if child not in skip:
                self.visit(child, level, depth)

    def all(self, nodes: list, level: int, depth: int) -> None:
        for n in nodes:
            self.visit(n, level, depth)

    def branch(self, level: int, depth: int) -> None:
        self.cyclomatic += 1
        self.cognitive += 1 + level
        self.depth = max(self.depth, depth + 1)

    def visit(self, node: ast.AST, level: int, depth: int) -> None:
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                self.all(node.decorator_list, level, depth)
            case ast.Lambda():
                self.children(node, level + 1, depth)
            case ast.If():
                self.branch(level, depth)
                self._if(node, level + 1, depth + 1)
            case ast.For() | ast.AsyncFor() | ast.While() | ast.ExceptHandler():
                self.branch(level, depth)
                self.children(node, level + 1, depth + 1)
            case ast.comprehension():
                self.branch(level, depth)
                self.all([node.target, node.iter], level + 1, depth + 1)
                for condition in node.ifs:
                    self.branch(level, depth)
                    self.visit(condition, level + 1, depth + 1)
            case ast.Match():
                self.cognitive += 1 + level
                self.depth = max(self.depth, depth + 1)
                self.children(node, level + 1, depth + 1)
            case ast.match_case():
                self.cyclomatic += not (isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None and node.pattern.name is None)
                self.children(node, level, depth)
            case ast.IfExp():
                self.cyclomatic += 1
                self.cognitive += 1 + level
                self.children(node, level + 1, depth)
            case ast.BoolOp():
                self.cyclomatic += len(node.values) - 1
                self.cognitive += 1
                self.children(node, level, depth)
            case _:
                self.children(node, level, depth)

    def _if(self, node: ast.If, level: int, depth: int) -> None:
        self.visit(node.test, level, depth)
        self.all(node.body, level, depth)
        if len(node.orelse) == 1 and id(node.orelse[0]) in self.elifs:
            self.cyclomatic += 1
            self.cognitive += 1
            self._if(node.orelse[0], level, depth)
        elif node.orelse:
            self.cognitive += 1
            self.all(node.orelse, level, depth)


class PythonFile:
    """All measurements of one text; raises SyntaxError where it isn't Python."""

    def __init__(self, text: str, prefix: str = DIRECTIVE_PREFIX):
        self.tree = ast.parse(text)
        self.directive = re.compile(rf"{prefix}-disable(-next-line|-line|-file)?\b[:\s]*([A-Za-z0-9,\s]*)", re.I)
        self.marker = re.compile(rf"\b({'|'.join(MARKERS)})\b[:\s-]*(.*)", re.ASCII)
        self.lines = text.split("\n")
        self.tokens: list[tuple[tuple[int, int], str, bool]] = []  # place, text, whether an operand
        self.rows: set[int] = set()
        self.comment_rows: set[int] = set()
        self.todos: list[dict] = []
        self.suppressions: list[dict] = []
        self._scan(text)
        self.places = [t[0] for t in self.tokens]
        self.code_rows = sorted(self.rows)
        self.elifs = {id(n.orelse[0]) for n in ast.walk(self.tree) if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and self.lines[n.orelse[0].lineno - 1].encode()[n.orelse[0].col_offset :].startswith(b"elif")}
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self._units: list[tuple[ast.AST, str, str, list[ast.AST]]] = []
        self._discover(self.tree, None, None, "")
        for unit in self._units:
            self.functions.append(self._measure(*unit))

    def _scan(self, text: str) -> None:
        softs = {(n.lineno - 1, n.col_offset) for n in ast.walk(self.tree) if isinstance(n, ast.Match)}
        whole, begin = 0, None
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            row, col = t.start[0] - 1, t.start[1]
            if t.type == tokenize.COMMENT:
                self.comment_rows.add(row)
                self._comment(t.string, row, col)
                continue
            if t.type in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
                continue
            self.rows.update(range(row, t.end[0]))
            name = tokenize.tok_name[t.type]
            if name in ("FSTRING_START", "TSTRING_START"):
                begin = begin or (row, col)
                whole += 1
                continue
            if whole:
                if name in ("FSTRING_END", "TSTRING_END"):
                    whole -= 1
                    if not whole:
                        self.tokens.append((begin, self._between(begin, (t.end[0] - 1, t.end[1])), True))
                        begin = None
                continue
            soft = t.string in ("match", "case") and ((row, col) in softs or (t.string == "case" and bool(softs) and self.lines[row][:col].strip() == ""))
            operand = t.type in (tokenize.NUMBER, tokenize.STRING) or (t.type == tokenize.NAME and not soft and (not keyword.iskeyword(t.string) or t.string in ("True", "False", "None")))
            self.tokens.append(((row, col), t.string, operand))

    def _between(self, a: tuple[int, int], b: tuple[int, int]) -> str:
        if a[0] == b[0]:
            return self.lines[a[0]][a[1] : b[1]]
        return "\n".join([self.lines[a[0]][a[1] :], *self.lines[a[0] + 1 : b[0]], self.lines[b[0]][: b[1]]])

    def _comment(self, text: str, row: int, col: int) -> None:
        if m := self.directive.search(text):
            scope = {"-file": "file", "-next-line": "nextLine"}.get((m[1] or "").lower(), "line")
            self.suppressions.append({"scope": scope, "line": row, "rules": re.findall(r"CQ\d{3}", m[2].upper())})
        if m := self.marker.search(text):
            self.todos.append({"line": row, "col": col + m.start(), "text": f"{m[1]} {m[2]}".strip()[:MARKER_LENGTH]})

    def _discover(self, node: ast.AST, unit: list | None, own: dict | None, name: str) -> None:
        for c in ast.iter_child_nodes(node):
            given = name if isinstance(node, (ast.Assign, ast.AnnAssign, ast.keyword)) else ""
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)) or (isinstance(c, ast.Lambda) and unit is None):
                is_lambda, nested = isinstance(c, ast.Lambda), []
                if own is not None and not is_lambda:
                    own["methods"] += 1
                if unit is not None:
                    unit.append(c)
                label = given if is_lambda else c.name
                self._units.append((c, "lambda" if is_lambda else "method" if own is not None else "function", (label or "<anonymous>")[:NAME_LENGTH], nested))
                self._discover(c, nested, None, "")
            elif isinstance(c, ast.ClassDef):
                if unit is not None:
                    unit.append(c)
                cls = {"name": c.name[:NAME_LENGTH], "start_line": c.lineno - 1, "start_col": self._col(c), "end_line": c.end_lineno - 1, "methods": 0}
                self.classes.append(cls)
                self._discover(c, None, cls, "")
            else:
                target = c.targets[0] if isinstance(c, ast.Assign) else getattr(c, "target", None)
                label = c.arg or "" if isinstance(c, ast.keyword) else target.id if isinstance(target, ast.Name) else ""
                self._discover(c, unit, own, label)

    def _col(self, node: ast.AST) -> int:
        return len(self.lines[node.lineno - 1].encode()[: node.col_offset].decode("utf-8", "replace"))

    def _range(self, node: ast.AST) -> tuple[tuple[int, int], tuple[int, int]]:
        end = self.lines[node.end_lineno - 1].encode()[: node.end_col_offset].decode("utf-8", "replace")
        return (node.lineno - 1, self._col(node)), (node.end_lineno - 1, len(end))

    def _measure(self, node: ast.AST, kind: str, name: str, nested: list[ast.AST]) -> dict:
        start, end = self._range(node)
        holes = [self._range(n) for n in nested]
        operators, operands = [], []
        for at, text, operand in self.tokens[bisect_left(self.places, start) : bisect_left(self.places, end)]:
            if any(a <= at < b for a, b in holes):
                continue
            if operand:
                operands.append(text)
            elif text not in NO_OPERATORS:
                operators.append(text)
        c, h = Complexity(node, self.elifs), halstead(operators, operands)
        sloc = bisect_left(self.code_rows, end[0] + 1) - bisect_left(self.code_rows, start[0])
        a = node.args
        params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
        return {
            "name": name, "kind": kind, "start_line": start[0], "start_col": start[1], "end_line": end[0], "end_col": end[1], "params": params, "cyclomatic": c.cyclomatic,
            "cognitive": c.cognitive, "max_nesting": c.depth, "sloc": sloc, "halstead": h, "mi": maintainability(h["volume"], c.cyclomatic, sloc),
        }


def measure_structure(files: DataFrame, prefix: str = DIRECTIVE_PREFIX) -> DataFrame:
    """files(path, language_key, text, ...) with parsed, lines, sloc, comment_lines, line_lengths, functions, classes, todos, suppressions, token ids and their lines.

    ``parsed`` is false, and the rest null, where the text isn't what its language key says. A very deep or long text that the parser gives
    up on counts as not parsed. Rows are independent.
    """
    names = [c for c in files.columns if c != "text"]
    made = [("parsed", pa.bool_()), ("lines", pa.int32()), ("sloc", pa.int32()), ("comment_lines", pa.int32()), ("line_lengths", pa.list_(pa.int32())), ("functions", pa.list_(FUNCTION)), ("classes", pa.list_(CLASS)), ("todos", pa.list_(TODO)), ("suppressions", pa.list_(SUPPRESSION)), ("ids", pa.list_(pa.int64())), ("token_lines", pa.list_(pa.int32()))]

    directive = re.compile(rf"{prefix}-disable(-next-line|-line|-file)?\b[:\s]*([A-Za-z0-9,\s]*)", re.I)

    def one(key: str, text: str) -> dict:
        try:
            if key in braces.SCANNED:
                p = braces.scan(text, key, directive)
                functions, tokens = p.functions(halstead, maintainability, NO_OPERATORS), [(t.text, t.row) for t in p.code]
            else:
                p = PythonFile(text, prefix)
                functions, tokens = p.functions, [(t, at[0]) for at, t, _ in p.tokens]
        except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError, tokenize.TokenError):
            return {"parsed": False}
        return {
            "parsed": True, "lines": len(p.lines), "sloc": len(p.rows), "comment_lines": len(p.comment_rows - p.rows), "line_lengths": [len(x.encode("utf-16-le", "surrogatepass")) // 2 for x in re.split("\r?\n", text)],
            "functions": functions, "classes": p.classes, "todos": p.todos, "suppressions": p.suppressions, "ids": [fnv1a(t) for t, _ in tokens], "token_lines": [row for _, row in tokens],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(k or "", t or "") for t, k in zip(batch.column(0).to_pylist(), batch.column(names.index("language_key") + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([r.get(k) for r in rows], t) for k, t in made), batch.column(0)], names=[*names, *(k for k, _ in made), "text"])

    function = "array<struct<name:string,kind:string,start_line:int,start_col:int,end_line:int,end_col:int,params:int,cyclomatic:int,cognitive:int,max_nesting:int,sloc:int,halstead:struct<distinct_operators:int,distinct_operands:int,total_operators:int,total_operands:int,volume:double,difficulty:double,effort:double>,mi:double>>"
    schema = "parsed boolean, lines int, sloc int, comment_lines int, line_lengths array<int>, " f"functions {function}, classes array<struct<name:string,start_line:int,start_col:int,end_line:int,methods:int>>, todos array<struct<line:int,col:int,text:string>>, suppressions array<struct<scope:string,line:int,rules:array<string>>>, ids array<long>, token_lines array<int>, text string"
    types = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names)
    return files.select(F.col("text").alias("__text"), *names).mapInArrow(run, f"{types}, {schema}")


def analyze(routed: DataFrame, prefix: str = DIRECTIVE_PREFIX) -> DataFrame:
    """Routed files (operators/routing.py) with one row each of measurements, whatever their tier.

    Tier 1 is parsed; what doesn't parse becomes tier 2 with has_syntax_errors. Tier 3 keeps zeros and empty lists.
    Parsed files have their tokens as ids and token_lines, which are null elsewhere: see token_stream().
    """
    generic = measure_generic(routed.where("tier = 2"), prefix=prefix).withColumn("has_syntax_errors", F.lit(False))
    parsed = measure_structure(routed.where("tier = 1"), prefix)
    whole = parsed.where("parsed").withColumns({"has_syntax_errors": F.lit(False), "indent_nesting": F.lit(None).cast("struct<depth:int,line:int>")})
    broken = parsed.where("NOT parsed").select(*routed.columns).withColumns({"tier": F.lit(2), "note": F.lit("does not parse; partial analysis")})
    broken = measure_generic(broken, prefix=prefix).withColumn("has_syntax_errors", F.lit(True))
    skipped = routed.where("tier = 3").withColumn("has_syntax_errors", F.lit(False)).withColumns({"lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)), "sloc": F.lit(0), "comment_lines": F.lit(0)})
    columns = [*routed.columns, "lines", "sloc", "comment_lines", "line_lengths", "functions", "classes", "todos", "suppressions", "indent_nesting", "has_syntax_errors", "ids", "token_lines"]
    types = {f.name: f.dataType for f in whole.schema}
    out = None
    for part in (whole, generic, broken, skipped):
        full = part.withColumns({c: F.from_json(F.lit("[]"), types[c]) if c in ("functions", "classes", "todos", "suppressions", "line_lengths") else F.lit(None).cast(types[c]) for c in columns if c not in part.columns}).select(*columns)
        out = full if out is None else out.unionByName(full)
    return out


def token_stream(analyzed: DataFrame) -> DataFrame:
    """path, ids and lines of analyze()'s files for clones: a parsed file's own tokens, comments left out by its grammar; of the others those of their code lines."""
    parsed = analyzed.where("ids IS NOT NULL").select("path", "ids", F.col("token_lines").alias("lines"))
    return parsed.unionByName(token_arrays(analyzed.where("ids IS NULL AND tier = 2")))


def name_by_cell(functions: DataFrame, cells: DataFrame) -> DataFrame:
    """functions(path, start_line, name) with the number of the notebook's cell in the name; cells(path, line, cell). Functions of other files stay."""
    named = functions.join(cells.select("path", F.col("line").alias("start_line"), "cell"), ["path", "start_line"], "left")
    return named.withColumn("name", F.when(F.col("cell").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" (cell "), F.col("cell").cast("string"), F.lit(")")))).drop("cell")


def rename_in_notebooks(analyzed: DataFrame, cells: DataFrame) -> DataFrame:
    """analyze()'s files where functions of notebooks have their cell's number in the name; cells(path, line, cell)."""
    by_line = cells.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line", "cell"))).alias("__cells"))
    named = F.transform("functions", lambda f: f.withField("name", F.coalesce(F.concat(f["name"], F.lit(" (cell "), F.try_element_at("__cells", f["start_line"]).cast("string"), F.lit(")")), f["name"])))
    joined = analyzed.join(by_line, "path", "left")
    return joined.withColumn("functions", F.when(F.col("__cells").isNull(), F.col("functions")).otherwise(named)).drop("__cells").select(*analyzed.columns)
