"""Notebooks: the code cells as one Python text, with the cell of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = "struct<cells:array<struct<cell_type:string,source:string>>>"


def _cells(text):
    """Code cells as structs of their number (from 1) and lines. source is a string or a list of strings."""
    cells = F.from_json(text, _CELLS)["cells"]
    numbered = F.transform(cells, lambda c, i: F.struct((i + 1).cast("int").alias("cell"), c["cell_type"].alias("kind"), c["source"].alias("source")))
    code = F.filter(numbered, lambda c: c["kind"] == "code")
    listed = lambda s: F.from_json(s, "array<string>")
    whole = lambda s: F.when(s.startswith("[") & s.endswith("]") & listed(s).isNotNull(), F.array_join(listed(s), "")).otherwise(s)
    magic = lambda l: F.when(l.rlike(r"^\s*[%!]"), F.concat(F.lit("# "), l)).otherwise(l)  # noqa: E731, E741
    return F.transform(code, lambda c: F.struct(c["cell"].alias("cell"), F.transform(F.split(F.coalesce(whole(c["source"]), F.lit("")), "\n", -1), magic).alias("lines")))


def code_lines(books: DataFrame) -> DataFrame:
    """path, line (from 0 over all code), cell and code; books(path, text). What isn't a notebook has no lines."""
    flat = F.flatten(F.transform("__cells", lambda c: F.transform(c["lines"], lambda l: F.struct(c["cell"].alias("cell"), l.alias("code")))))  # noqa: E741
    df = books.select("path", _cells(F.col("text")).alias("__cells"))
    return df.select("path", F.posexplode(flat).alias("line", "x")).select("path", "line", "x.cell", "x.code")


def as_python(books: DataFrame) -> DataFrame:
    """books(path, text, ...) with the code as text, and valid: whether it was a notebook at all."""
    df = books.withColumn("__cells", _cells(F.col("text")))
    joined = F.array_join(F.flatten(F.transform("__cells", lambda c: c["lines"])), "\n")
    return df.withColumns({"valid": F.col("__cells").isNotNull(), "text": F.coalesce(joined, F.lit(""))}).drop("__cells")
