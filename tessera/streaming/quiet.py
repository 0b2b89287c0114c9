"""Versions that have been quiet: of samples that follow each other closely only the last is let out, in keyed state.

The same rule serves edits of a document (wait until nobody types) and trends (a sample replaces the last one within a
minute). ``quiet_rows`` gives it over a table, ``quiet_stream`` over a stream.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType, TimestampType


def quiet_rows(rows: DataFrame, key: str, at: str, gap_ms: int, *ties: str) -> DataFrame:
    """The rows of a table that no row of the same key follows within ``gap_ms``; of rows with one time the last by ``ties`` counts."""
    w = Window.partitionBy(key).orderBy(at, *ties)
    ms = F.unix_millis(at)
    return rows.withColumn("__next", F.lead(ms).over(w)).where(F.col("__next").isNull() | (F.col("__next") - ms >= gap_ms)).drop("__next")


_EPOCH, _MS = datetime.datetime(1970, 1, 1), datetime.timedelta(milliseconds=1)


def _plain(column: pd.Series) -> list:
    """A column's values as plain ones, nulls as None."""
    return [None if v is None or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in column.tolist()]


def _settled(rows: list[tuple], at: int, gap: datetime.timedelta, until: datetime.datetime) -> tuple[list[tuple], list[tuple], list[datetime.datetime]]:
    """Of rows in order, those that are let out, those that are held, and when these are due; rows that still come are later than ``until``.

    A row that nothing follows closely is let out when nothing can any more. One that is followed will never be, but is held
    while a row before it can come that it follows closely. Rows without a time come last and are held.
    """
    out, rest, due = [], [], []
    for row, after in zip(rows, [*rows[1:], None], strict=True):
        t, following = row[at], after and after[at]
        last = t is None or following is None or following - t >= gap
        end = None if t is None else t + gap if last else t
        if end is None or end > until:
            rest.append(row)
            due += [] if end is None else [end]
        elif last:
            out.append(row)
    return out, rest, due


def quiet_stream(rows: DataFrame, key: str, at: str, gap_ms: int, late: str = "10 seconds", ties: tuple[str, ...] = ()) -> DataFrame:
    """The same over a stream, by event time: a row comes out once the watermark is ``gap_ms`` past it and nothing has followed.

    The result is that of quiet_rows() over all rows that came before the watermark passed them; later ones are dropped.
    Within the watermark rows may come in any order and in any split into batches. State holds, for each key, the rows that
    may still be let out, and those that a row which is still to come could precede closely.
    """
    kept = StructType([f for f in rows.schema.fields if f.name != key])
    state = StructType([StructField("open", ArrayType(kept))])
    names = [f.name for f in kept.fields]
    place, gap, order = names.index(at), datetime.timedelta(milliseconds=gap_ms), [names.index(c) for c in (at, *ties)]

    def step(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        every = [tuple(r) for r in held.get[0]] if held.exists else []
        for b in batches:  # a group has few rows, so plain values are much faster than frames
            every += zip(*(_plain(b[c]) for c in names), strict=True)
        every.sort(key=lambda r: [(r[i] is None, r[i]) for i in order])
        out, rest, due = _settled(every, place, gap, _EPOCH + held.getCurrentWatermarkMs() * _MS)
        if rest:
            held.update((rest,))
            held.setTimeoutTimestamp(max(-((_EPOCH - min(due)) // _MS) if due else 0, held.getCurrentWatermarkMs() + 1))
        else:
            held.remove()
        if out:
            yield pd.DataFrame([(group[0], *r) for r in out], columns=[key, *names])

    shape = StructType([rows.schema[key], *kept.fields])
    if not isinstance(rows.schema[at].dataType, TimestampType):
        raise ValueError(f"{at} must be a timestamp")
    return rows.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, shape, state, "append", GroupStateTimeout.EventTimeTimeout)


def debounce(edits: DataFrame, delay_ms: int = 300, key: str = "path", generation: str = "generation") -> DataFrame:
    """A stream with the newest version of each document, by generation, once it has been left alone for ``delay_ms`` of the clock.

    Each edit starts the document's timer anew; when it runs out the newest version comes out and the state goes. An edit
    that is older than the one that waits changes nothing. Timers are looked at when the query's trigger fires.
    """
    rest = StructType([f for f in edits.schema.fields if f.name != key])
    names = [f.name for f in rest.fields]
    place = names.index(generation)

    def step(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(held.get) if held.exists else None
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([[group[0], *waiting]], columns=[key, *names])
            return
        for batch in batches:
            best = batch.loc[batch[generation].idxmax(), names]
            if waiting is None or best[generation] > waiting[place]:
                waiting = [None if v is pd.NaT or (isinstance(v, float) and pd.isna(v)) else v.item() if hasattr(v, "item") else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in best]
        held.update(tuple(waiting))
        held.setTimeoutDuration(delay_ms)

    shape = StructType([edits.schema[key], *rest.fields])
    return edits.groupBy(key).applyInPandasWithState(step, shape, rest, "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_edits(events: DataFrame) -> DataFrame:
    """Events as edits: the user's document, its time, the event's number as generation, and what was done."""
    return events.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("generation"), F.col("event_type").alias("text"))


