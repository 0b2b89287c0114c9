"""Orders, navigation and layout over file marts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered, numbered_within
from tessera.operators.rules import SEVERITIES
from tessera.session import kept

# Proportions of the layout, and the limits of the panels.
SHRINK, LEAST_FLOORS, MOST_FLOORS, ASPECT = 0.74, 3, 6, 1.6
LEAST_WIDTH, MOST_WIDTH, FLAT = 0.62, 0.96, 0.55
CELL, PAD, LEAST_SIDE, LEAST_FIT, MOST_FIT = 1, 0.55, 1.8, 0.3, 1.35
STEP, LEAST_PITCH, MOST_PITCH, MOST_RATIO = 0.105, 0.85, 2.2, 0.5
MOST_SLAB, SLAB_SHARE, LEAST_HEIGHT, CLEARANCE = 0.26, 0.26, 0.07, 0.14
TOP_FOLDERS, PANEL_FUNCTIONS, PANEL_FINDINGS, LENS_SYMBOLS, TABLE_ROWS = 12, 200, 300, 300, 25
METRICS = {"debt": "debt", "cyclomatic": "max_cc", "cognitive": "max_cog", "duplication": "dup_lines"}


def sort_list(mart: DataFrame, column: str, descending: bool = True) -> DataFrame:
    return mart.orderBy(F.col(column).desc() if descending else F.col(column).asc(), "path")


def by_metric(mart: DataFrame, metric: str) -> DataFrame:
    """Files in the order of one of METRICS, the worst first."""
    return sort_list(mart, METRICS[metric])


def worst_file(mart: DataFrame) -> DataFrame:
    return mart.orderBy(F.desc("debt"), "path").limit(1)


def top_folders(mart: DataFrame, n: int = TOP_FOLDERS) -> DataFrame:
    """Files by the first segment of their path, the most first."""
    return mart.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "folder").limit(n)


def navigation(mart: DataFrame, within: str) -> DataFrame:
    """path, next and previous in the order of debt and path, around the ends, inside each group of ``within``."""
    w = Window.partitionBy(within).orderBy(F.desc("debt"), "path")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return mart.select(within, "path", F.coalesce(F.lead("path").over(w), F.first("path").over(every)).alias("next"), F.coalesce(F.lag("path").over(w), F.last("path").over(every)).alias("previous"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def issues_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("debt_minutes").alias("debt_minutes")).orderBy("rule_id")


def issues_by_file(findings: DataFrame) -> DataFrame:
    """Findings, the files with the most debt first, and in a file by severity and line."""
    debt = findings.groupBy("path").agg(F.sum("debt_minutes").alias("file_debt"))
    return findings.join(debt, "path").orderBy(F.desc("file_debt"), "path", severity_rank(F.col("severity")), "line", "rule_id")


def panel_symbols(symbols: DataFrame, most: int = PANEL_FUNCTIONS) -> DataFrame:
    """The functions of each file with the most debt."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("debt_minutes"), "start_line", "name"))
    return symbols.withColumn("rank", rank).where(F.col("rank") <= most)


def panel_findings(findings: DataFrame, most: int = PANEL_FINDINGS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("path").orderBy(severity_rank(F.col("severity")), "line", "rule_id"))
    return findings.withColumn("rank", rank).where(F.col("rank") <= most)


def lens_symbols(symbols: DataFrame, most: int = LENS_SYMBOLS) -> DataFrame:
    """Symbols of files that don't have too many to be shown in place."""
    count = symbols.groupBy("path").count().where(F.col("count") <= most)
    return symbols.join(count.select("path"), "path", "left_semi")


def worst_line(findings: DataFrame) -> DataFrame:
    """The line to open a file at: that of the finding with the most debt, the first on a tie."""
    return findings.groupBy("path").agg(F.max_by("line", F.struct("debt_minutes", -F.col("line"))).alias("line"))


def shown_in_drawer() -> Column:
    return (F.col("severity") != "info") | (F.col("rule_id") == "CQ011")


def share_percent(value: Column, total: Column) -> Column:
    return F.floor(100 * value / F.greatest(total, F.lit(1)) + 0.5)


def log_height(value: Column, most: Column) -> Column:
    """0 to 1 on a logarithmic scale; flat where there is nothing to tell apart."""
    return F.when(most <= 0, F.lit(FLAT)).when(value <= 0, F.lit(0.0)).otherwise(F.log1p(value) / F.log1p(most))


def tiers(mart: DataFrame) -> DataFrame:
    """mart with ``floor`` (0 at the bottom, the most files first) and ``tier``, what the floor's files have in common.

    A tier is a folder depth; above MOST_FLOORS the deepest merge. While there are less than LEAST_FLOORS, the tier with the
    most files (the least deep on a tie) that lies in several folders becomes a tier for each folder; where no tier does, the
    largest one is cut by size into as many bands of equal count, the largest files first, as are missing.

    Folders are counted on the cluster; the driver sees depths, and the folders of a tier only where these are two at most.
    """
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    told = mart.withColumns({"__depth": F.size(parts) - 1, "__folder": folder})
    folders = kept(told.groupBy("__depth", "__folder").agg(F.count(F.lit(1)).alias("__n")))
    depths = [(r["__depth"], r["n"], r["k"]) for r in folders.groupBy("__depth").agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k")).orderBy("__depth").collect()]
    top = {d: min(i, MOST_FLOORS - 1) for i, (d, _, _) in enumerate(depths)}
    index = F.element_at(F.create_map(*(F.lit(x) for kv in top.items() for x in kv)), F.col("__depth")) if top else F.lit(0)
    told, folders = told.withColumn("__tier", index), folders.withColumn("__tier", index)
    count = min(len(depths), MOST_FLOORS)
    split, banded, bands = None, None, 1
    if 0 < count < LEAST_FLOORS:
        several = [i for i in range(count) if depths[i][2] > 1 and depths[i][1] > 1]
        # of at most two tiers, one with several folders makes up the number if there is another, or if it has three
        while several and count < LEAST_FLOORS:
            i = max(several, key=lambda i: (depths[i][1], -i))
            split = {*(split or ()), i}
            several.remove(i)
            count += depths[i][2] - 1
        if count < LEAST_FLOORS:  # two tiers of a folder each, or one: few enough to look at
            few = folders.groupBy("__tier", F.when(F.col("__tier").isin(*(split or [-1])), F.col("__folder")).alias("__own")).agg(F.sum("__n").alias("n")).collect()
            largest = min(few, key=lambda r: (-r["n"], r["__tier"], r["__own"] or ""))
            bands = min(LEAST_FLOORS - count + 1, largest["n"]) if largest["n"] >= LEAST_FLOORS else 1
            banded = largest if bands > 1 else None
    own = F.when(F.col("__tier").isin(*split), F.col("__folder")).otherwise("") if split else F.lit("")
    told, folders = told.withColumn("__own", own), folders.withColumn("__own", own)
    if banded is not None:
        inside = _banded(banded)
        placed = numbered(told.where(inside), F.desc("sloc"), F.asc("path"), name="__k")
        base, extra = divmod(banded["n"], bands)
        edge = extra * (base + 1)  # the first ``extra`` bands have one file more
        band = F.when(F.col("__k") < edge, F.floor(F.col("__k") / (base + 1))).otherwise(extra + F.floor((F.col("__k") - edge) / base)).cast("int")
        told = placed.withColumn("__band", band).drop("__k").unionByName(told.where(~inside).withColumn("__band", F.lit(0)))
    else:
        told = told.withColumn("__band", F.lit(0))
    told = kept(told)
    sizes = told.groupBy("__tier", "__own", "__band").agg(F.count(F.lit(1)).alias("__n"), F.min("__depth").alias("__least"))
    # the largest at the bottom; equal ones in the order in which they were made: by depth, then folders by size and name
    ranked = numbered(sizes, F.desc("__n"), F.asc("__tier"), F.asc("__own"), F.asc("__band"), name="floor")
    label = F.when(F.col("__own") != "", F.col("__own")).when(F.col("__least") == 0, "root").otherwise(F.concat(F.lit("depth "), F.col("__least").cast("string")))
    label = F.when(_banded(banded), F.concat(F.lit("size band "), (F.col("__band") + 1).cast("string"))).otherwise(label)
    floors = ranked.select(*(F.col(c).alias(f"{c}_of") for c in ("__tier", "__own", "__band")), F.col("floor").cast("int").alias("floor"), label.alias("tier"))
    same = [told[c] == floors[f"{c}_of"] for c in ("__tier", "__own", "__band")]
    return told.join(floors, same).select(*(told[c] for c in mart.columns), "floor", "tier")


def _banded(banded) -> Column:
    return F.lit(False) if banded is None else (F.col("__tier") == banded["__tier"]) & (F.col("__own") == (banded["__own"] or ""))


def place_blocks(floored: DataFrame) -> DataFrame:
    """Place and size of each file of floored(path, sloc, debt, floor): adds row, column, side, x, z, width and height.

    A floor is a square grid that files fill by path in snake order, and each floor's side is SHRINK of the one below. A
    block is as wide as its share of the cell by lines, and as high as its debt says on a logarithmic scale, at most
    ASPECT times as high as wide. Files are numbered within a floor over as many tasks as there are, and no task holds one.
    """
    placed = numbered_within(floored, "floor", "path", name="__k", size="__files")
    columns = F.ceil(F.sqrt(F.col("__files"))).cast("long")
    most = floored.agg(F.greatest(F.lit(1), F.max("sloc")).alias("sloc"), F.greatest(F.lit(0), F.max("debt")).alias("debt")).first()
    floors = floored.groupBy("floor").agg(F.count(F.lit(1)).alias("n"))
    facts = floors.agg(F.max(F.when(F.col("floor") == 0, F.col("n"))).alias("n"), F.count(F.lit(1)).alias("floors")).first()
    if not facts["floors"]:
        return placed.select(*floored.columns, *(F.lit(None).cast(t).alias(c) for c, t in (("row", "int"), ("column", "int"), ("side", "double"), ("x", "double"), ("z", "double"), ("width", "double"), ("height", "double"))))
    grid = math.isqrt(facts["n"] - 1) + 1
    base = max(grid, -(-facts["n"] // grid)) * CELL + 2 * PAD
    pitch = min(min(MOST_PITCH, max(LEAST_PITCH, base * STEP)), MOST_RATIO * base / facts["floors"])
    slab = min(MOST_SLAB, pitch * SLAB_SHARE)
    tallest = max(LEAST_HEIGHT * 2, pitch - slab - CLEARANCE * pitch)
    row, along = F.floor(F.col("__k") / columns), F.col("__k") % columns
    rows = F.ceil(F.col("__files") / columns)
    column = F.when(row % 2 == 0, along).otherwise(columns - 1 - along)
    side = F.greatest(F.lit(LEAST_SIDE), base * F.pow(F.lit(SHRINK), F.col("floor")))
    fit = F.greatest(F.lit(LEAST_FIT), F.least(F.lit(MOST_FIT), (side - 2 * PAD) / F.greatest(columns, rows)))
    width = (LEAST_WIDTH + (MOST_WIDTH - LEAST_WIDTH) * F.sqrt(F.col("sloc") / most["sloc"])) * fit
    height = F.least(LEAST_HEIGHT + (tallest - LEAST_HEIGHT) * log_height(F.col("debt"), F.lit(most["debt"])), width * ASPECT)
    return placed.select(
        *floored.columns, row.cast("int").alias("row"), column.cast("int").alias("column"), side.alias("side"),
        ((column - (columns - 1) / 2) * CELL * fit).alias("x"), ((row - (rows - 1) / 2) * CELL * fit).alias("z"), width.alias("width"), height.alias("height"),
    )


def squarify(sizes: list[float], x: float, y: float, width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Rectangles of the given areas' shares (sizes falling), each row as square as can be."""
    total = sum(sizes)
    if total <= 0:
        return [(x, y, 0.0, 0.0) for _ in sizes]
    areas = [s * width * height / total for s in sizes]
    out: list[tuple[float, float, float, float]] = []
    while areas:
        short = min(width, height)
        worst = lambda row: max(max(short**2 * a / sum(row) ** 2, sum(row) ** 2 / (short**2 * a)) if a else float("inf") for a in row)
        n = 1
        while n < len(areas) and areas[n] > 0 and worst(areas[: n + 1]) <= worst(areas[:n]):
            n += 1
        row, areas = areas[:n], areas[n:]
        thick = sum(row) / short if short else 0.0
        at = 0.0
        for a in row:
            length = a / thick if thick else 0.0
            out.append((x, y + at, thick, length) if width >= height else (x + at, y, length, thick))
            at += length
        if width >= height:
            x, width = x + thick, width - thick
        else:
            y, height = y + thick, height - thick
    return out

