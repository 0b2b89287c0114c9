"""Structural measurements of languages with braces, and of four whose blocks are words, by a scanner over tokens.

It stands in for full grammars: functions are a name, a parameter list and a block; control flow is read from keywords.
Macros, unusual layouts and code that doesn't balance are measured as far as they can be read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from tessera.functions.text import MARKERS

LANGUAGES = ("c", "cpp", "c_sharp", "dart", "go", "java", "javascript", "typescript", "tsx", "kotlin", "objc", "php", "rescript", "rust", "scala", "solidity", "swift", "zig")

_LEX = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)*')|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$@][\w$]*)"""
    r"""|(?P<op>=>|->|&&|\|\||\?\?=?|\?\.|\?:|::|[=!<>]=|[+\-*/%&|^]=|\+\+|--|[^\s\w])""",
    re.S,
)
_RUST_LIFETIME = re.compile(r"'(?=[a-z_]\w*\b(?!'))")
LOOPS = frozenset(["for", "while", "foreach"])
#: Words for multi-way branches and endless loops that are names elsewhere.
SWITCHES = {"rust": {"match"}, "scala": {"match"}, "kotlin": {"when"}, "go": {"switch", "select"}, "php": {"switch", "match"}}
#: Languages whose branches are patterns with an arrow, and patterns that take all that is left.
ARMS = frozenset(["rust", "scala", "kotlin", "zig", "rescript", "elixir"])
REST = frozenset(["_", "else", "true"])
OWN_LOOPS = {"rust": {"loop"}}
CLASSES = frozenset(["class", "struct", "interface", "enum", "trait", "impl", "object", "contract", "union", "record", "extension", "protocol", "library"])
NAMED = frozenset(["function", "func", "fn", "fun", "def"])
NO_FUNCTION = LOOPS | {"if", "else", "catch", "return", "do", "try", "finally", "sizeof", "new", "throw", "await", "using", "lock", "guard", "elseif", "in", "defer", "unsafe", "go"}


@dataclass
class Token:
    text: str
    kind: str
    row: int
    col: int
    made: bool = False


@dataclass
class Unit:
    name: str
    kind: str
    first: int
    params: int
    last: int = 0
    cyclomatic: int = 1
    cognitive: int = 0
    depth: int = 0
    nested: list[tuple[int, int]] = field(default_factory=list)


class BraceFile:
    """Units, classes, tokens and rows of one text; the same attributes as a parsed file has."""

    def __init__(self, text: str, language: str, directive: re.Pattern):
        self.language, self.lines = language, text.split("\n")
        self.switches, self.loops = SWITCHES.get(language, {"switch"}), LOOPS | OWN_LOOPS.get(language, set())
        self.marker = re.compile(rf"\b({'|'.join(MARKERS)})\b[:\s-]*(.*)", re.ASCII)
        self.code: list[Token] = []
        self.rows: set[int] = set()
        self.comment_rows: set[int] = set()
        self.todos: list[dict] = []
        self.suppressions: list[dict] = []
        self._lex(text, directive)
        self._rewrite()
        self.close = self._match()
        self.units: list[Unit] = []
        self.classes: list[dict] = []
        self._declarations(0, len(self.code), None, None)

    # --- tokens ---

    def lexer(self) -> re.Pattern:
        return _LEX

    def _lex(self, text: str, directive: re.Pattern) -> None:
        starts = [0]
        for m in re.finditer("\n", text):
            starts.append(m.end())
        row, at = 0, 0
        lex = self.lexer()
        while m := lex.search(text, at):
            at = m.end()
            if self.language == "rust" and m["string"] and m["string"][0] == "'" and _RUST_LIFETIME.match(text, m.start()):
                at = m.start() + 1
                continue
            while row + 1 < len(starts) and starts[row + 1] <= m.start():
                row += 1
            col = m.start() - starts[row]
            if m["comment"]:
                for k, line in enumerate(m["comment"].split("\n")):
                    self.comment_rows.add(row + k)
                    if d := directive.search(line):
                        scope = {"-file": "file", "-next-line": "nextLine"}.get((d[1] or "").lower(), "line")
                        self.suppressions.append({"scope": scope, "line": row + k, "rules": re.findall(r"CQ\d{3}", d[2].upper())})
                    if t := self.marker.search(line):
                        self.todos.append({"line": row + k, "col": t.start() + (0 if k else col), "text": f"{t[1]} {t[2]}".removesuffix("*/").strip()[:120]})
                continue
            self.rows.update(range(row, row + m[0].count("\n") + 1))
            self.code.append(Token(m[0], m.lastgroup, row, col))

    def _rewrite(self) -> None:
        """For languages whose blocks are words: see KeywordFile."""

    def _match(self) -> dict[int, int]:
        """The place of the bracket that closes each opening one; the end where none does."""
        pairs, stack = {"(": ")", "[": "]", "{": "}"}, []
        out: dict[int, int] = {}
        for i, t in enumerate(self.code):
            if t.kind != "op":
                continue
            if t.text in pairs:
                stack.append(i)
            elif t.text in ")]}":
                while stack:
                    j = stack.pop()
                    out[j] = i
                    if pairs[self.code[j].text] == t.text:
                        break
        for j in stack:
            out[j] = len(self.code)
        return out

    def _is(self, i: int, *texts: str) -> bool:
        return i < len(self.code) and self.code[i].text in texts and self.code[i].kind in ("op", "name")

    # --- declarations ---

    def _block_after(self, i: int, end: int) -> int | None:
        """The { of a body that follows a parameter list closing before i: across types, qualifiers and initialisers, not across statements."""
        while i < end:
            t = self.code[i]
            if t.text == "{" and t.kind == "op":
                return i
            if t.kind == "op" and t.text in ("(", "["):
                i = self.close[i] + 1
                continue
            if t.kind == "op" and t.text in (";", "}", "=", ",", ")", "=>", "&&", "||", "?"):
                return None
            i += 1
        return None

    def _function_at(self, i: int, end: int) -> tuple[str, int, int] | None:
        """Name, place of the parameter list and place of the body, if a function starts at token i."""
        t = self.code[i]
        if t.kind != "name":
            return None
        j, name = i, ""
        if t.text in NAMED:
            j += 1
            if self._is(j, "*"):
                j += 1
            if self._is(j, "("):  # a receiver, or no name at all
                k = self.close[j] + 1
                if self.language == "go" and k < end and self.code[k].kind == "name" and self._is(k + 1, "("):
                    j = k
            if j < end and self.code[j].kind == "name":
                name = self.code[j].text
                j += 1
                while self._is(j, ".", ":", "::") and j + 1 < end and self.code[j + 1].kind == "name":
                    name, j = self.code[j + 1].text, j + 2
            if self._is(j, "<", "["):
                close = {"<": ">", "[": "]"}[self.code[j].text]
                while j < end and self.code[j].text != close:
                    j += 1
                j += 1
        elif t.text not in NO_FUNCTION | self.switches | self.loops and self._is(i + 1, "(") and not (i and self._is(i - 1, ".", "->", "=", "new", "return", "?.", "!", "&&", "||", "@")):
            name, j = t.text, i + 1
        else:
            return None
        if not self._is(j, "("):
            return None
        body = self._block_after(self.close[j] + 1, end)
        if body is None and t.text in NAMED and self.language in ("scala", "kotlin"):
            k = self.close[j] + 1
            while k < end and self.code[k].text not in ("=", "{", "}", ";"):
                k += 1
            body = k + 1 if self._is(k, "=") and self._is(k + 1, "{") else None
        return None if body is None else (name or "<anonymous>", j, body)

    def _params(self, at: int) -> int:
        end, n, depth, angle = self.close[at], 1, 0, 0
        if end <= at + 1 or (end == at + 2 and self.code[at + 1].text == "void"):
            return 0
        for t in self.code[at + 1 : end]:
            if t.kind == "op":
                depth += (t.text in "([{") - (t.text in ")]}")
                angle += (t.text == "<") - (t.text == ">")
                n += t.text == "," and depth == 0 and angle <= 0
        return n - (self.code[end - 1].text == ",")

    def _declarations(self, i: int, end: int, unit: Unit | None, cls: dict | None) -> None:
        while i < end:
            t = self.code[i]
            if t.kind == "name" and t.text in CLASSES and not (i and self._is(i - 1, ".", "=", "(")) and i + 1 < end and self.code[i + 1].kind == "name":
                body = self._block_after(i + 1, end)
                if body is not None:
                    own = {"name": self.code[i + 1].text[:60], "start_line": t.row, "start_col": t.col, "end_line": self.code[min(self.close[body], len(self.code) - 1)].row, "methods": 0}
                    self.classes.append(own)
                    if unit is not None:
                        unit.nested.append((i, self.close[body]))
                    self._declarations(body + 1, self.close[body], None, own)
                    i = self.close[body] + 1
                    continue
            found = self._function_at(i, end)
            if found:
                i = self._unit(i, *found, unit, "method" if cls is not None else "function", cls)
                continue
            if self._is(i, "=>") and self._is(i + 1, "{"):
                i = self._unit(i, self._given(i), i, i + 1, unit, "function" if self.language == "rescript" else "lambda", None)
                continue
            i += 1

    def _given(self, i: int) -> str:
        """The name that an arrow function is assigned to."""
        j = i - 1
        while j > 0 and self.code[j].text not in (";", "{", "}", "="):
            j -= 1
        return self.code[j - 1].text if j > 0 and self.code[j].text == "=" and self.code[j - 1].kind == "name" else "<anonymous>"

    def _unit(self, first: int, name: str, params: int, body: int, outer: Unit | None, kind: str, cls: dict | None) -> int:
        if cls is not None:
            cls["methods"] += 1
        count = self._params(params) if self._is(params, "(") else self._params(max(0, next((j for j, c in self.close.items() if c == params - 1 and self._is(j, "(")), 0))) if self._is(params - 1, ")") else 1
        u = Unit(name[:60], kind, first, count, self.close[body])
        if outer is not None:
            outer.nested.append((first, u.last))
        self.units.append(u)
        self._walk(body + 1, u.last, u, 0, 0)
        return u.last + 1

    # --- control flow ---

    def _walk(self, i: int, end: int, u: Unit, level: int, depth: int) -> None:
        while i < end:
            i = self._statement(i, end, u, level, depth)

    def _enter(self, u: Unit, level: int, depth: int) -> None:
        u.cyclomatic += 1
        u.cognitive += 1 + level
        u.depth = max(u.depth, depth + 1)

    def _header(self, i: int, end: int, u: Unit, level: int, depth: int) -> int:
        """Over a condition: in brackets, or up to the block."""
        if self._is(i, "("):
            close = self.close[i]
            if self.language not in ("go", "rust", "swift", "rescript") or self._is(close + 1, "{"):
                self._expression(i + 1, close, u, level, depth)
                return close + 1
        j = i
        while j < end and not self._is(j, "{"):
            j = self.close[j] + 1 if self._is(j, "(", "[") else j + 1
        self._expression(i, min(j, end), u, level, depth)
        return j

    def _statement(self, i: int, end: int, u: Unit, level: int, depth: int) -> int:
        t = self.code[i]
        word = t.text if t.kind == "name" else ""
        if self._is(i, "{"):
            self._walk(i + 1, min(self.close[i], end), u, level, depth)
            return self.close[i] + 1
        if word == "if":
            self._enter(u, level, depth)
            return self._if(i + 1, end, u, level + 1, depth + 1)
        if word in self.loops:
            self._enter(u, level, depth)
            j = self._header(i + 1, end, u, level + 1, depth + 1)
            return self._statement(j, end, u, level + 1, depth + 1) if j < end else j
        if word == "do" or (word == "repeat" and self.language == "swift"):
            if not self._is(i + 1, "{") or self.language == "swift" and word == "do":
                return i + 1
            self._enter(u, level, depth)
            j = self._statement(i + 1, end, u, level + 1, depth + 1)
            return self._header(j + 1, end, u, level + 1, depth + 1) if self._is(j, "while") and self._is(j + 1, "(") else j
        if word in self.switches and not self._is(i + 1, ".", "=", ",", ")", ";"):
            j = self._header(i + 1, end, u, level + 1, depth + 1)
            if self._is(j, "{"):
                u.cognitive += 1 + level
                u.depth = max(u.depth, depth + 1)
                self._cases(j, u, level + 1, depth + 1)
                return self.close[j] + 1
            return j
        if word == "catch":
            self._enter(u, level, depth)
            j = self._header(i + 1, end, u, level + 1, depth + 1) if self._is(i + 1, "(") else i + 1
            return self._statement(j, end, u, level + 1, depth + 1) if j < end else j
        if word == "goto":
            u.cognitive += 1
        j = i
        while j < end and not self._is(j, ";", "}"):
            if self._is(j, "{") or (self.language == "rescript" and j > i and self._is(j, "|")):
                break
            if j > i and self.code[j].kind == "name" and self.code[j].text in self.loops | {"if", "catch", "do", "try"} and self.code[j].row > self.code[j - 1].row:
                break
            j = self.close[j] + 1 if self._is(j, "(", "[") else j + 1
        stop = min(max(j, i), end)
        self._expression(i, stop, u, level, depth)
        if self._is(j, "{") and j < end:
            inner = self._is(j - 1, "=>", "in", "->") or (self._is(j - 1, ")") and self.language in ("kotlin", "swift", "dart"))
            if (found := next((f for k in range(max(i, j - 40), j) if (f := self._function_at(k, end)) and f[2] == j), None)) is not None:
                name, params, body = found
                named = name != "<anonymous>" and self.language not in ("javascript", "typescript", "tsx") or self._is(i, "function", "fn", "func", "fun", "def")
                if named:
                    return self._unit(i, name, params, body, u, "function", None)
                inner = True
            self._walk(j + 1, min(self.close[j], end), u, level + (1 if inner else 0), depth)
            return self.close[j] + 1
        return max(j + 1, i + 1) if self._is(j, ";", "}") else max(j, i + 1)

    def _if(self, i: int, end: int, u: Unit, level: int, depth: int) -> int:
        j = self._header(i, end, u, level, depth)
        j = self._statement(j, end, u, level, depth) if j < end else j
        if self._is(j, "elseif") or (self._is(j, "else") and self._is(j + 1, "if")):
            u.cyclomatic += 1
            u.cognitive += 1
            return self._if(j + (1 if self._is(j, "elseif") else 2), end, u, level, depth)
        if self._is(j, "else"):
            u.cognitive += 1
            return self._statement(j + 1, end, u, level, depth) if j + 1 < end else j + 1
        return j

    def _cases(self, at: int, u: Unit, level: int, depth: int) -> None:
        i, end = at + 1, self.close[at]
        arms = self.language in ARMS
        while i < end:
            if arms and self._is(i, "=>", "->"):
                before = self.code[i - 1].text
                u.cyclomatic += before not in (REST if self.language == "elixir" else REST - {"true"})
                i += 1
            elif not arms and self._is(i, "case"):
                u.cyclomatic += 1
                while i < end and not self._is(i, ":", "->", "=>"):
                    i += 1
                i += 1
            elif not arms and self._is(i, "default") or (arms and self._is(i, "case", ",")):
                i += 1
            elif arms and not any(self._is(k, "=>", "->") for k in (i,)) and self._arm_head(i, end):
                head = self._arm_head(i, end) or i + 1
                if self.language in ("elixir", "rescript"):  # conditions and guards
                    self._expression(i, head, u, level, depth)
                i = head
            else:
                i = self._statement(i, end, u, level, depth)

    def _arm_head(self, i: int, end: int) -> int | None:
        """The arrow of an arm whose pattern starts at i."""
        j = i
        while j < end and not self._is(j, ";", "{", "}"):
            if self._is(j, "=>", "->"):
                return j
            j = self.close[j] + 1 if self._is(j, "(", "[") else j + 1
        return None

    def _expression(self, i: int, end: int, u: Unit, level: int, depth: int) -> None:
        last = ""
        ternary = level
        while i < end:
            t = self.code[i]
            if t.kind == "modifier":
                self._enter(u, ternary, depth)
            elif t.kind == "op":
                if t.text in ("&&", "||"):
                    u.cyclomatic += 1
                    u.cognitive += t.text != last
                    last = t.text
                elif t.text == "?" and self.language not in ("rust", "kotlin", "scala", "go") and any(self._is(k, ":") for k in range(i + 1, end)):
                    u.cyclomatic += 1
                    u.cognitive += 1 + ternary
                    ternary += 1
                elif t.text in ("(", "["):
                    self._expression(i + 1, min(self.close[i], end), u, ternary, depth)
                    i = self.close[i] + 1
                    continue
                elif t.text == "{":
                    inner = self._is(i - 1, "=>", "->", "in", ")")
                    self._walk(i + 1, min(self.close[i], end), u, ternary + inner, depth)
                    i = self.close[i] + 1
                    continue
                elif t.text in (",", ";", "=", "=>"):
                    last = ""
            elif t.kind == "name" and t.text in ("and", "or") and self.language in ("zig", "php"):
                u.cyclomatic += 1
                u.cognitive += t.text != last
                last = t.text
            elif t.kind == "name" and t.text in self.switches | {"if"} and self.language in ("rust", "kotlin", "scala", "zig", "swift"):
                i = self._statement(i, end, u, ternary, depth)
                continue
            i += 1

    # --- results ---

    def functions(self, halstead, maintainability, no_operators) -> list[dict]:
        out, rows = [], sorted(self.rows)
        for u in self.units:
            last = self.code[min(u.last, len(self.code) - 1)]
            first = self.code[u.first]
            own = [t for k, t in enumerate(self.code[u.first : u.last + 1], u.first) if not t.made and not any(a <= k <= b for a, b in u.nested)]
            h = halstead([t.text for t in own if t.kind == "op" and t.text not in no_operators], [t.text for t in own if t.kind != "op"])
            sloc = bisect_left(rows, last.row + 1) - bisect_left(rows, first.row)
            out.append({
                "name": u.name, "kind": u.kind, "start_line": first.row, "start_col": first.col, "end_line": last.row, "end_col": last.col + 1, "params": u.params, "cyclomatic": u.cyclomatic,
                "cognitive": u.cognitive, "max_nesting": u.depth, "sloc": sloc, "halstead": h, "mi": maintainability(h["volume"], u.cyclomatic, sloc),
            })
        return out


_WORD_COMMENTS = {"elixir": r"\#[^\n]*", "lua": r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*", "ruby": r"(?<![$\w])\#[^\n]*", "bash": r"(?<![$\w{])\#[^\n]*"}
_WORD_LEX = {
    k: re.compile(rf"""(?P<comment>{c})|(?P<string>\"{{3}}.*?\"{{3}}|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$@][\w$]*[?!]?)|(?P<op>&&|\|\||=>|->|;;|[=!<>~]=|[^\s\w])""", re.S)
    for k, c in _WORD_COMMENTS.items()
}


class KeywordFile(BraceFile):
    """The same for languages whose blocks begin and end with words: these are turned into brackets first."""

    def lexer(self) -> re.Pattern:
        return _WORD_LEX[self.language]

    def _rewrite(self) -> None:
        out: list[Token] = []
        code, waiting, cases = self.code, "", 0
        depth = 0
        for k, t in enumerate(code):
            new_line = k == 0 or code[k - 1].row < t.row or code[k - 1].text in (";", "then", "do", "else")
            made = lambda *texts, t=t: out.extend(Token(x, "name" if x.isalpha() else "op", t.row, t.col, True) for x in texts)
            if self.language == "ruby" and new_line and waiting and depth == 0:
                if any(x.text == "def" for x in out[-2:]):  # no parameters
                    made("(", ")")
                made(waiting)
                waiting = ""
            depth += t.kind == "op" and (t.text in "([") - (t.text in ")]")
            word = t.text if t.kind == "name" else ""
            if self.language == "elixir" and new_line and depth == 0 and out and not self._joins(code, k):
                made(";")
            if self.language == "elixir" and word in ("do", "else", "rescue", "catch", "after") and k + 1 < len(code) and code[k + 1].text == ":":
                out.append(t)
            elif word == "and" or word == "or":
                made("&&" if word == "and" else "||")
            elif word in ("end", "fi", "done", "esac") and not (word == "end" and self.language == "bash") and not (word != "end" and self.language != "bash"):
                made("}")
                cases -= word == "esac"
            elif word in ("elseif", "elsif", "elif"):
                made("}", "else", "if")
                waiting = "{"
            elif word == "else" and out and out[-1].text != "}":
                made("}", "else", "{")
            elif word in ("then", "do") and not (self.language == "ruby" and word == "do" and waiting != "{"):
                if self.language == "elixir" and len(out) > 1 and out[-2].text == "def":  # no parameters
                    made("(", ")")
                made("{" if waiting != ":" else ":")
                waiting = ""
            elif self.language == "lua":
                self._lua(t, word, out, made)
            elif self.language == "elixir":
                self._elixir(t, word, out, made)
            elif self.language == "bash":
                if word == "case" and new_line:
                    made("switch")
                    cases += 1
                elif word == "in" and cases and any(x.text == "switch" for x in out[-4:]):
                    made("{")
                elif t.text == ")" and t.kind == "op" and cases and depth < 0:
                    made(";", "default" if code[k - 1].text == "*" else "case", ":")
                    depth = 0
                elif t.text == ";;":
                    made(";")
                else:
                    out.append(t)
            else:
                waiting = self._ruby(t, word, new_line, waiting, out, made)
        self.code = out

    @staticmethod
    def _joins(code: list[Token], k: int) -> bool:
        """Whether the line that begins at token k goes on with the statement before."""
        return code[k - 1].text in (",", "->", "=", "|", "&&", "||", "and", "or") or code[k].text in ("|", ")", "]", "}", "&&", "||", "and", "or")

    def _elixir(self, t: Token, word: str, out: list[Token], made) -> None:
        if word in ("def", "defp", "defmacro", "defmacrop"):
            made("def")
        elif word == "defmodule":
            made("class")
        elif word in ("cond", "case", "receive"):
            made("switch")
        elif word == "unless":
            made("if")
        elif word == "fn":
            made("=>", "{")
        elif word in ("rescue", "catch"):
            made("}", "catch", "{")
        elif word == "after":
            made("}", "finally", "{")
        else:
            out.append(t)

    def _lua(self, t: Token, word: str, out: list[Token], made) -> None:
        if word == "repeat":
            made("do", "{")
        elif word == "until":
            made("}")
        else:
            out.append(t)
            if t.text == ")" and t.kind == "op":  # the list of a function's parameters
                n = 0
                for j in range(len(out) - 1, -1, -1):
                    n += (out[j].text == ")") - (out[j].text == "(") if out[j].kind == "op" else 0
                    if n == 0:
                        if any(x.text == "function" for x in out[max(0, j - 4) : j]) and not any(x.text in ("(", ")", "{", "}") for x in out[max(0, j - 1) : j]):
                            made("{")
                        break

    def _ruby(self, t: Token, word: str, new_line: bool, waiting: str, out: list[Token], made) -> str:
        if word in ("if", "unless", "while", "until") and not new_line:
            out.append(Token(t.text, "modifier", t.row, t.col))
        elif word in ("if", "unless"):
            made("if")
            return "{"
        elif word in ("while", "until", "for"):
            made("while")
            return "{"
        elif word == "case":
            made("switch")
            return "{"
        elif word == "when":
            made("case")
            return ":"
        elif word in ("def", "class", "module") and new_line:
            out.append(t)
            if word == "def":
                out[-1] = Token("def", "name", t.row, t.col)
            return "{"
        elif word == "begin":
            made("try", "{")
        elif word == "rescue":
            made("}", "catch")
            return "{"
        elif word == "ensure":
            made("}", "finally", "{")
        elif word == "do":
            made("=>", "{")
        elif t.text == "." and len(out) > 1 and out[-1].text == "self" and out[-2].text == "def":
            out.pop()
        else:
            out.append(t)
        return waiting


SCANNED = (*LANGUAGES, *_WORD_LEX)


def scan(text: str, language: str, directive: re.Pattern) -> BraceFile:
    return (KeywordFile if language in _WORD_LEX else BraceFile)(text, language, directive)
