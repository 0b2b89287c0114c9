"""Which language a path is in, and how that language writes comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages, their names and extensions, as results show them.
STRUCTURED = {
    "bash": ("Bash", [".sh", ".bash", ".zsh"]),
    "c": ("C", [".c", ".h"]),
    "cpp": ("C++", [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".ipp", ".inl"]),
    "c_sharp": ("C#", [".cs"]),
    "dart": ("Dart", [".dart"]),
    "elixir": ("Elixir", [".ex", ".exs"]),
    "go": ("Go", [".go"]),
    "java": ("Java", [".java"]),
    "javascript": ("JavaScript", [".js", ".jsx", ".mjs", ".cjs"]),
    "typescript": ("TypeScript", [".ts", ".mts", ".cts"]),
    "tsx": ("TypeScript React", [".tsx"]),
    "kotlin": ("Kotlin", [".kt", ".kts"]),
    "lua": ("Lua", [".lua"]),
    "objc": ("Objective-C", [".m", ".mm"]),
    "ocaml": ("OCaml", [".ml", ".mli"]),
    "php": ("PHP", [".php", ".phtml"]),
    "python": ("Python", [".py", ".pyw", ".pyi"]),
    "rescript": ("ReScript", [".res", ".resi"]),
    "ruby": ("Ruby", [".rb", ".rake", ".gemspec"]),
    "rust": ("Rust", [".rs"]),
    "scala": ("Scala", [".scala", ".sc"]),
    "solidity": ("Solidity", [".sol"]),
    "swift": ("Swift", [".swift"]),
    "zig": ("Zig", [".zig"]),
}
# Languages that are measured from text alone: name, comment prefixes, extensions.
PLAIN = {
    "elm": ("Elm", ["--"], [".elm"]),
    "haskell": ("Haskell", ["--"], [".hs", ".lhs"]),
    "pascal": ("Pascal", ["//", "{", "(*"], [".pas", ".pp", ".dpr"]),
    "fortran": ("Fortran", ["!", "c ", "C "], [".f", ".for", ".f77", ".f90", ".f95", ".f03", ".f08"]),
    "vb": ("Visual Basic", ["'", "REM "], [".vb", ".vbs", ".bas"]),
    "r": ("R", ["#"], [".r"]),
    "julia": ("Julia", ["#"], [".jl"]),
    "perl": ("Perl", ["#"], [".pl", ".pm", ".t"]),
    "clojure": ("Clojure", [";"], [".clj", ".cljs", ".cljc", ".edn"]),
    "lisp": ("Lisp", [";"], [".lisp", ".lsp", ".el", ".scm", ".ss", ".rkt"]),
    "erlang": ("Erlang", ["%"], [".erl", ".hrl"]),
    "fsharp": ("F#", ["//"], [".fs", ".fsi", ".fsx"]),
    "groovy": ("Groovy", ["//"], [".groovy", ".gradle", ".gvy"]),
    "powershell": ("PowerShell", ["#"], [".ps1", ".psm1", ".psd1"]),
    "batch": ("Batch", ["REM ", "rem ", "::"], [".bat", ".cmd"]),
    "sql": ("SQL", ["--"], [".sql", ".psql", ".plsql"]),
    "asm": ("Assembly", [";", "#", "//"], [".asm", ".s", ".nasm"]),
    "verilog": ("Verilog", ["//"], [".v", ".sv", ".svh", ".vh"]),
    "vhdl": ("VHDL", ["--"], [".vhd", ".vhdl"]),
    "cobol": ("COBOL", ["*"], [".cob", ".cbl", ".cpy"]),
    "ada": ("Ada", ["--"], [".ada", ".adb", ".ads"]),
    "tcl": ("Tcl", ["#"], [".tcl"]),
    "nim": ("Nim", ["#"], [".nim"]),
    "crystal": ("Crystal", ["#"], [".cr"]),
    "d": ("D", ["//"], [".d"]),
    "matlab": ("MATLAB/Octave", ["%"], [".matlab"]),
    "coffeescript": ("CoffeeScript", ["#"], [".coffee"]),
    "vue": ("Vue SFC", ["//", "<!--"], [".vue"]),
    "svelte": ("Svelte", ["//", "<!--"], [".svelte"]),
    "html": ("HTML", ["<!--"], [".html", ".htm"]),
    "css": ("CSS", ["/*"], [".css", ".scss", ".sass", ".less", ".styl"]),
    "gdscript": ("GDScript", ["#"], [".gd"]),
    "cuda": ("CUDA", ["//"], [".cu", ".cuh"]),
    "glsl": ("GLSL/HLSL", ["//"], [".glsl", ".vert", ".frag", ".hlsl", ".shader"]),
    "prolog": ("Prolog", ["%"], [".pro", ".prolog"]),
    "apex": ("Apex", ["//"], [".cls", ".trigger"]),
    "abap": ("ABAP", ["*", "\""], [".abap"]),
    "makefile": ("Makefile", ["#"], [".mk"]),
    "cmake": ("CMake", ["#"], [".cmake"]),
    "dockerfile": ("Dockerfile", ["#"], [".dockerfile"]),
    "terraform": ("Terraform/HCL", ["#", "//"], [".tf", ".hcl"]),
    "protobuf": ("Protocol Buffers", ["//"], [".proto"]),
    "graphql": ("GraphQL", ["#"], [".graphql", ".gql"]),
}
# File names without a telling extension, and extensions of data, settings and prose.
SPECIAL_NAMES = {"makefile": "tier2:makefile", "gnumakefile": "tier2:makefile", "dockerfile": "tier2:dockerfile", "cmakelists.txt": "tier2:cmake", "rakefile": "ruby", "gemfile": "ruby", "jenkinsfile": "tier2:groovy"}
NOT_SOURCE = [
    ".json", ".jsonc", ".yaml", ".yml", ".toml", ".xml", ".md", ".markdown", ".txt", ".csv",
    ".tsv", ".lock", ".ini", ".cfg", ".conf", ".env", ".properties", ".rst", ".svg", ".log",
    ".ipynb_checkpoints", ".map", ".snap",
]
UNKNOWN_COMMENTS = ["//", "#"]
NO_INDENT_NESTING = ["html", "css", "vue", "svelte", "xml"]
LINE_COMMENTS = {"python": "#", "bash": "#", "ruby": "#", "elixir": "#", "lua": "--", "sql": "--"}
BLOCK_COMMENTS = {"ocaml": ("(*", "*)")}


def extension_map() -> dict[str, str]:
    """Extension to language key; structured languages come first where two claim one."""
    out = {e: key for key, (_, exts) in STRUCTURED.items() for e in exts}
    for key, (_, _, exts) in PLAIN.items():
        for e in exts:
            out.setdefault(e, f"tier2:{key}")
    return out


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.element_at(F.create_map(*flat), key)


def detect_language(path: Column, extra_extensions: tuple[str, ...] = ()) -> Column:
    """The language key of a path, null for files that aren't measured.

    Whole file names first, then notebooks, then extensions known not to be source, then the extension; extensions the
    user adds are plain languages of that name.
    """
    base = F.lower(F.regexp_extract(path, r"[^/\\]*$", 0))
    ext = F.when(F.contains(base, F.lit(".")), F.regexp_extract(base, r"\.[^.]*$", 0))
    extra = [e.lower() for e in extra_extensions]
    return (
        F.when(base.isin(*SPECIAL_NAMES), _lookup(base, SPECIAL_NAMES))
        .when(ext.isNull(), F.lit(None))
        .when(ext == ".ipynb", "notebook:python")
        .when(ext.isin(*NOT_SOURCE), F.lit(None))
        .otherwise(F.coalesce(_lookup(ext, extension_map()), F.when(ext.isin(*extra), F.concat(F.lit("tier2:"), F.substring(ext, 2, 99))) if extra else F.lit(None)))
    )


def plain_name(key: Column) -> Column:
    return F.regexp_replace(key, "^(tier2|notebook):", "")


def comment_prefixes(key: Column) -> Column:
    """The full-line comment prefixes of a language key, as an array."""
    known = F.create_map(*(x for k, (_, c, _) in PLAIN.items() for x in (F.lit(k), F.array(*map(F.lit, c)))))
    return F.coalesce(F.element_at(known, plain_name(key)), F.array(*map(F.lit, UNKNOWN_COMMENTS)))


def display_name(key: Column) -> Column:
    names = {k: n for k, (n, _) in STRUCTURED.items()} | {f"tier2:{k}": v[0] for k, v in PLAIN.items()}
    return F.when(F.startswith(key, F.lit("notebook:")), "Jupyter Notebook").otherwise(
        F.coalesce(_lookup(key, names), F.when(F.startswith(key, F.lit("tier2:")), F.upper(plain_name(key))).otherwise(key))
    )


def languages(spark: SparkSession) -> DataFrame:
    """The dimension of languages: key, name, tier, comment prefixes, extensions."""
    rows = [(k, n, 1, list(UNKNOWN_COMMENTS), e) for k, (n, e) in STRUCTURED.items()]
    rows += [(f"tier2:{k}", n, 2, c, e) for k, (n, c, e) in PLAIN.items()]
    return spark.createDataFrame(rows, "language_key string, name string, tier int, comments array<string>, extensions array<string>")


def known_extensions(spark: SparkSession) -> DataFrame:
    """Every extension that is measured, and the key that it leads to."""
    return spark.createDataFrame([*extension_map().items(), (".ipynb", "notebook:python")], "extension string, language_key string")


def comment_text(key: str, body: str) -> str:
    """body as a comment of the language."""
    name = key.removeprefix("tier2:").removeprefix("notebook:")
    if name in BLOCK_COMMENTS:
        return f"{BLOCK_COMMENTS[name][0]} {body} {BLOCK_COMMENTS[name][1]}"
    return f"{LINE_COMMENTS.get(name, '//')} {body}"
