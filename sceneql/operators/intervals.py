"""Interval and sequence algebra: merging, islands, sweeps, thinning, snapping and projection onto frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from sceneql.operators.joins import overlap_join
from sceneql.sources.package import ship


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float = 0.0, tie: Sequence[str] = (), out: str = "island") -> DataFrame:
    """df with the number of the run of intervals it belongs to: a run goes on while the next start lies within `gap` of the farthest end so far."""
    order = Window.partitionBy(*keys).orderBy(start, end, *tie)
    far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.when(far.isNull() | (F.col(start) - far > gap), 1).otherwise(0))
    return d.withColumn(out, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float = 0.0, tie: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """One row for each run: its start, its end, how many intervals it has, and any further aggregates."""
    d = islands(df, keys, start, end, gap, tie)
    return d.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *aggregates).drop("island")


def merged_duration(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, out: str = "seconds") -> DataFrame:
    """Seconds covered by the intervals of each key; gaps of at most `gap` are bridged and count."""
    return merge(df, keys, start, end, gap).groupBy(*keys).agg(F.round(F.sum(F.col(end) - F.col(start)), 6).alias(out))


def merge_same(df: DataFrame, keys: Sequence[str], label: str, start: str, end: str, gap: float | None, tie: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """Runs of neighbours with one label and gaps of at most `gap` (None: any gap) as one row each."""
    order = Window.partitionBy(*keys).orderBy(start, end, *tie)
    before = F.lag(end).over(order)
    new = F.lag(label).over(order).isNull() | (F.lag(label).over(order) != F.col(label))
    if gap is not None:
        new = new | (F.col(start) - before > gap)
    d = df.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, label, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *aggregates).drop("_run")


def overlap_regions(df: DataFrame, keys: Sequence[str], start: str, end: str, who: str, least: float = 0.0, at_least: int = 2, width: float = 8.0) -> DataFrame:
    """Maximal stretches in which the same set of two or more speakers is active, as (start, end, speakers).

    The stretches between neighbouring edges meet the intervals in buckets of `width`, so that a key's rows are no product.
    """
    points = df.select(*keys, F.col(start).alias("lo")).union(df.select(*keys, F.col(end).alias("lo"))).distinct()
    order = Window.partitionBy(*keys).orderBy("lo")
    cells = points.withColumn("hi", F.lead("lo").over(order)).where("hi is not null and hi > lo")
    spans = df.select(*keys, F.col(who).cast("string").alias("_who"), F.col(start).alias("_from"), F.col(end).alias("_to"))
    active = overlap_join(cells, spans, keys, "lo", "hi", "_from", "_to", width).groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_set("_who")).alias("speakers"))
    many = active.where(F.size("speakers") >= at_least).withColumn("set", F.concat_ws("|", "speakers"))
    return merge_same(many, keys, "set", "lo", "hi", 0.0).where(F.col("hi") - F.col("lo") >= least).select(*keys, F.col("lo").alias("start"), F.col("hi").alias("end"), F.col("set").alias("speakers"))


def _ordered(df: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str = "rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(out))


def thin(df: DataFrame, keys: Sequence[str], at: str, least: float, tie: str) -> DataFrame:
    """Rows at least `least` after the last kept one, in order: a fold over each key's ordered points."""
    d = _ordered(df, keys, [at, tie])
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<struct<{at}:double,{tie}:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        keep = acc["last"].isNull() | (x[at] - acc["last"] >= least)
        return F.struct(F.when(keep, x[at].cast("double")).otherwise(acc["last"]).alias("last"), F.when(keep, F.concat(acc["kept"], F.array(F.struct(x[at].cast("double").alias(at), x[tie].cast("bigint").alias(tie))))).otherwise(acc["kept"]).alias("kept"))

    return d.select(*keys, F.explode(F.aggregate("rows", start, step, lambda a: a["kept"])).alias("r")).select(*keys, f"r.{at}", f"r.{tie}")


def group_while(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, join: Column, longest: float, most: int, out: str = "group_id") -> DataFrame:
    """Greedy grouping of ordered rows: a row joins the current group where `join` (of the row and its predecessor) holds
    and the group, with it, spans at most `longest` and has at most `most` rows. A fold, since both caps depend on where
    the group began."""
    d = df.withColumn("_join", F.coalesce(join, F.lit(False)))
    names = [*order, start, end, "_join"]
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)]))).alias("rows"))
    s, e, j = (f"c{len(order) + i}" for i in range(3))
    zero = F.struct(F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("from"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        goes_on = (acc["n"] > 0) & x[j] & (x[e] - acc["from"] <= longest) & (acc["n"] < most)
        gid = F.when(goes_on, acc["id"]).otherwise(acc["id"] + 1)
        return F.struct(gid.cast("bigint").alias("id"), F.when(goes_on, acc["from"]).otherwise(x[s].cast("double")).alias("from"), F.when(goes_on, acc["n"] + 1).otherwise(F.lit(1)).cast("bigint").alias("n"), F.concat(acc["ids"], F.array(gid.cast("bigint"))).alias("ids"))

    ids = F.aggregate("rows", zero, step, lambda a: a["ids"])
    return g.select(*keys, F.explode(F.arrays_zip(F.col("rows").alias("r"), ids.alias("i"))).alias("z")).select(*keys, *[F.col(f"z.r.c{i}").alias(n) for i, n in enumerate(order)], F.col(f"z.r.{s}").alias(start), F.col(f"z.r.{e}").alias(end), F.col("z.i").alias(out))


def group_by_continuity(df: DataFrame, keys: Sequence[str], row: str, start: str, end: str, credits: Column, continuity: str, shortest: float = 8.0, weak: float = 0.40, longest: float = 72.0, out: str = "group_id") -> DataFrame:
    """(keys, row, group): a new group where credits begin or end, where 8 s have passed and the continuity with the row
    before is weak, or where the group would reach 72 s. A fold, as both times count from the group's start."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), credits.alias("k"), F.col(continuity).cast("double").alias("c")))).alias("rows"))
    zero = F.struct(F.lit(1).cast("bigint").alias("id"), F.lit(None).cast("double").alias("from"), F.lit(None).cast("boolean").alias("k"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["from"].isNotNull() & ((x["k"] != acc["k"]) | ((x["s"] - acc["from"] >= shortest) & (x["c"] < weak)) | (x["e"] - acc["from"] >= longest))
        gid = F.when(new, acc["id"] + 1).otherwise(acc["id"])
        return F.struct(gid.cast("bigint").alias("id"), F.when(new | acc["from"].isNull(), x["s"]).otherwise(acc["from"]).alias("from"), x["k"].alias("k"), F.concat(acc["ids"], F.array(gid.cast("bigint"))).alias("ids"))

    ids = F.aggregate("rows", zero, step, lambda a: a["ids"])
    return g.select(*keys, F.explode(F.arrays_zip(F.col("rows").alias("r"), ids.alias("i"))).alias("z")).select(*keys, F.col("z.r.r").alias(row), F.col("z.i").alias(out))


def snap(df: DataFrame, grid: DataFrame, keys: Sequence[str], at: str, point: str, out: str) -> DataFrame:
    """df with the grid point nearest to `at`, the first one on ties: the last point up to it or the next one, by two windows."""
    side = df.withColumn("_at", F.col(at).cast("double")).withColumn("_point", F.lit(None).cast("double")).withColumn("_row", F.lit(True))
    points = grid.select(*keys, F.col(point).cast("double").alias("_at"), F.col(point).cast("double").alias("_point"), F.lit(False).alias("_row")).distinct()
    both = side.unionByName(points, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0)
    # the opposite order, for a frame that grows row by row
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("_p", F.max("_point").over(past)).withColumn("_n", F.min("_point").over(ahead)).where("_row")
    near = F.when(F.col("_n").isNull() | (F.col("_at") - F.col("_p") <= F.col("_n") - F.col("_at")), F.col("_p")).otherwise(F.col("_n"))
    return d.withColumn(out, near).select(*df.columns, out)


def frames(df: DataFrame, start: str, end: str, duration: str, n_frames: str) -> DataFrame:
    """df with first_frame and end_frame of [start, end) on n_frames over the duration: half-even rounding, clamped; raises on bad intervals."""
    bad = F.when((F.col(end) < F.col(start)) | (F.col(start) < 0), F.raise_error(F.lit("an interval is negative")))
    a = F.rint(F.col(start) * F.col(n_frames) / F.col(duration)).cast("long")
    z = F.rint(F.col(end) * F.col(n_frames) / F.col(duration)).cast("long")
    clamp = lambda c: F.least(F.greatest(c, F.lit(0).cast("long")), F.col(n_frames).cast("long"))
    return df.withColumn("first_frame", F.coalesce(bad.cast("long"), clamp(a))).withColumn("end_frame", clamp(z))


def outside_turns(start: np.ndarray, end: np.ndarray, turns: np.ndarray, pad: float, duration: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Edges moved out of turns (rows of start and end) until none lies strictly inside one, within 0 and the duration.

    An edge within several turns leaves the one that starts first. Turns are sorted and their running last end found, so
    that this turn is one search, and each move takes an edge out of one turn for good.
    """
    a, z = np.maximum(start.astype(float), 0.0), np.minimum(end.astype(float), duration)
    turns = turns[np.lexsort((turns[:, 1], turns[:, 0]))]
    reach = np.maximum.accumulate(turns[:, 1]) if len(turns) else np.zeros(0)

    def around(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(reach, x, "right")
        at = np.minimum(k, len(reach) - 1)
        return (k < len(reach)) & (turns[at, 0] < x), at

    for edge, move in ((a, lambda at: np.maximum(0.0, turns[at, 0] - pad)), (z, lambda at: np.minimum(duration, turns[at, 1] + pad))):
        while len(reach):
            inside, at = around(edge)
            to = np.where(inside, move(at), edge)
            if not (np.abs(to - edge) >= 1e-6).any():
                break
            edge[:] = to
    return np.round(a, 3), np.round(z, 3)


def safe_bounds(df: DataFrame, turns: DataFrame, keys: Sequence[str], start: str, end: str, turn_start: str, turn_end: str, pad: float = 0.22, duration: str | None = None) -> DataFrame:
    """Intervals whose edges lie within no turn: an edge strictly inside a turn moves to the turn's edge, `pad` outside, until nothing moves.

    duration: the column with the video's end, beyond which no interval goes. A key's rows and turns meet in one group.
    """
    ship(df.sparkSession)
    schema = StructType([StructField(f.name, DoubleType() if f.name in (start, end) else f.dataType) for f in df.schema.fields])
    arrow = to_arrow_schema(schema)
    told = F.struct(F.col(turn_start).cast("double").alias("_s"), F.col(turn_end).cast("double").alias("_e"))
    both = df.select(*keys, F.struct(*df.columns).alias("_row")).unionByName(turns.select(*keys, told.alias("_turn")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, turns = b.column(len(keys)), b.column(len(keys) + 1)
            own = dict(zip(schema.names, rows.flatten().flatten()))
            a, z = (own[c].cast(pa.float64()).to_numpy(zero_copy_only=False).copy() for c in (start, end))
            edges = np.stack([c.to_numpy(zero_copy_only=False) for c in turns.flatten().flatten()], axis=1)
            i, t = (np.append(0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))) for x in (rows, turns))
            for g in np.flatnonzero(np.diff(i)):
                last = float(own[duration][i[g]].as_py()) if duration else np.inf
                own_ = slice(i[g], i[g + 1])
                a[own_], z[own_] = outside_turns(a[own_], z[own_], edges[t[g] : t[g + 1]], pad, last)
            own |= {start: pa.array(a, from_pandas=True), end: pa.array(z, from_pandas=True)}
            yield pa.RecordBatch.from_arrays([own[n].cast(k) for n, k in zip(arrow.names, arrow.types)], names=arrow.names)

    return both.groupBy(*keys).agg(F.collect_list("_row").alias("_rows"), F.collect_list("_turn").alias("_turns")).mapInArrow(run, schema)
