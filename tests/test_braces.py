from __future__ import annotations

import re

import pytest

from tessera.operators import routing, rules, structure
from tessera.operators.braces import BraceFile, scan
from tessera.plans.feature_queries import SYNTAXES

DIRECTIVE = re.compile(r"tessera-disable(-next-line|-line|-file)?\b[:\s]*([A-Za-z0-9,\s]*)", re.I)
#: Languages of the scanner; plans/feature_queries.py says how each writes functions, loops and branches.
SCANNED = [n for n in SYNTAXES if n != "python"]


@pytest.mark.parametrize("language", SCANNED)
def test_loops_and_branches(language):
    """A loop around a chain of branches; a chain of loops behind an early branch."""
    s = SYNTAXES[language]
    loop_end = "done" if language == "bash" else s.end
    chain = [s.head.format("spread"), s.loop, s.both, s.call, s.more, s.call, s.more, s.call, s.rest, s.call, s.end, loop_end, s.done]
    loops = [s.head.format("deepen"), s.plain, s.call, s.end, s.loop, s.loop, s.loop, s.call, loop_end, loop_end, loop_end, s.done]
    units = scan("\n".join([*chain, *loops]) + "\n", language, DIRECTIVE).units
    assert [(u.name, u.kind, u.cyclomatic, u.cognitive, u.depth, u.params) for u in units] == [("spread", "function", 6, 7, 2, s.params), ("deepen", "function", 5, 7, 3, s.params)]


ELIXIR = """defmodule Box do
  # TODO note
  def sort(a, b) do
    cond do
      a > 0 and b > 0 -> :both
      a < 0 -> :low
      true -> :rest
    end
  end

  defp each(xs, limit) do
    for x <- xs do
      if x > limit do
        Enum.map(xs, fn y -> y + 1 end)
      else
        x
      end
    end
  end

  def short(a), do: a

  def bare do
    case a do
      {:ok, x} -> x
      _ -> nil
    end
  end
end
"""


def test_elixir():
    f = scan(ELIXIR, "elixir", DIRECTIVE)
    assert [(u.name, u.kind, u.cyclomatic, u.cognitive, u.depth, u.params) for u in f.units] == [("sort", "method", 4, 2, 1, 2), ("each", "method", 3, 4, 2, 2), ("bare", "method", 2, 1, 1, 0)]
    assert [(c["name"], c["methods"]) for c in f.classes] == [("Box", 3)]
    for k in range(0, len(ELIXIR), 5):
        scan(ELIXIR[:k], "elixir", DIRECTIVE)


def test_rescript_arms():
    text = "let pick = (x, y) => {\n  switch x {\n  | A => 1\n  | B when y > 0 || z => 2\n  | _ => 3\n  }\n}\nlet second = y => {\n  if y { go() }\n}\n"
    units = scan(text, "rescript", DIRECTIVE).units
    assert [(u.name, u.kind, u.cyclomatic) for u in units] == [("pick", "function", 4), ("second", "function", 2)]


MIXED = """// tessera-disable-next-line CQ001
class A {
  run(x, y, z) {
    switch (x) { case 1: return y ? 1 : 2; case 2: break; default: break; }
    try { go(); } catch (e) { items.forEach((it) => { if (it && y || z) { log("a } b"); } }); } // TODO tidy
    return 0;
  }
  stop() { do { step(); } while (more()); }
}
const f = (a, b) => { return a; };
"""


def test_mixed():
    f = BraceFile(MIXED, "javascript", DIRECTIVE)
    assert [(u.name, u.kind, u.cyclomatic, u.cognitive, u.depth, u.params) for u in f.units] == [("run", "method", 8, 9, 2, 3), ("stop", "method", 2, 1, 1, 0), ("f", "lambda", 1, 0, 0, 2)]
    assert [(c["name"], c["methods"]) for c in f.classes] == [("A", 2)]
    assert f.suppressions == [{"scope": "nextLine", "line": 0, "rules": ["CQ001"]}]
    assert [t["text"] for t in f.todos] == ["TODO tidy"]


def test_arms_and_nested_units():
    rust = "fn f(x: i32) -> i32 {\n  match x {\n    1 => 2,\n    2 | 3 => { if y { 1 } else { 2 } }\n    _ => 0,\n  }\n}\n"
    assert [(u.cyclomatic, u.cognitive) for u in BraceFile(rust, "rust", DIRECTIVE).units] == [(4, 1 + 2 + 1)]
    nested = "function a() { function b(x) { if (x) { y(); } } return 1; }"
    assert [(u.name, u.cyclomatic) for u in BraceFile(nested, "javascript", DIRECTIVE).units] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("text", ["", "}", "{", "if (", "f(", "switch (x) { case", "do", "'", "/*", "else", "a ? b", "fn x(", "class", "=>", "catch {", "\0"])
@pytest.mark.parametrize("language", ["c", "rust", "javascript", "kotlin"])
def test_broken_text_ends(text, language):
    BraceFile(f"void g() {{ {text}", language, DIRECTIVE)
    BraceFile(text, language, DIRECTIVE)


def test_in_the_engine(spark):
    files = spark.createDataFrame([("a.js", "javascript", MIXED), ("b.ml", "ocaml", "let x = 1")], "path string, language_key string, text string")
    done = {r["path"]: r for r in rules.evaluate(structure.analyze(routing.route(files))).collect()}
    assert (done["a.js"]["tier"], len(done["a.js"]["functions"]), done["b.ml"]["tier"]) == (1, 3, 2)
    assert [f["rule_id"] for f in done["a.js"]["findings"]] == ["CQ011"]


WORDS = {
    "lua": "-- note\nlocal function first(a, b)\n  repeat\n    step(a)\n  until a > b\nend\nfunction M.second(a, b)\n  for i = 1, a do\n    if i == b or b then\n      f(function(x) return x end)\n    end\n  end\nend\n",
    "ruby": "class A\n  def first(a, b)\n    step(a) until b.empty?\n    a.each do |x|\n      x\n    end\n  end\n\n  def second(a, b)\n    for i in a\n      unless i == b || b\n        f(i)\n      end\n    end\n  end\n\n  def self.none\n    begin\n      x\n    rescue E => e\n      nil\n    end\n  end\nend\n",
    "bash": "first() {\n  until [ $a ]; do\n    step\n  done\n}\nfunction second() {\n  for i in $a; do\n    if [ $i ] || [ $b ]; then\n      f\n    fi\n  done\n}\npick() {\n  case $1 in\n    a) x ;;\n    *) y ;;\n  esac\n}\n",
}


@pytest.mark.parametrize("language", WORDS)
def test_word_blocks(language):
    units = scan(WORDS[language], language, DIRECTIVE).units
    assert [u.name for u in units[:2]] == ["first", "second"]
    assert (units[1].cyclomatic, units[1].cognitive, units[1].depth) == (4, 4, 2)
    if language == "ruby":
        assert (units[2].name, units[2].cyclomatic, units[2].params) == ("none", 2, 0)
    if language == "bash":
        assert (units[2].name, units[2].cyclomatic) == ("pick", 2)
    for k in range(0, len(WORDS[language]), 7):
        scan(WORDS[language][:k], language, DIRECTIVE)
