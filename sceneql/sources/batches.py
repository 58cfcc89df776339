"""Batches of calls with retries in halves, and runs of stages that report progress and can be cancelled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """A run was cancelled before the named stage."""


def in_halves(rows: list, call: Callable[[list], list], tries: int = 2) -> tuple[list, list]:
    """(results, failed rows): a failed batch is tried again, then in halves, down to single rows."""
    if not rows:
        return [], []
    for _ in range(tries):
        try:
            return list(call(rows)), []
        except Exception:  # noqa: BLE001  any failure of the caller's function counts
            continue
    if len(rows) == 1:
        return [], rows
    half = len(rows) // 2
    a, b = in_halves(rows[:half], call, tries), in_halves(rows[half:], call, tries)
    return a[0] + b[0], a[1] + b[1]


def run_stages(spark: SparkSession, stages: Sequence[tuple[str, Callable[[], object]]], progress: Callable[[str, int, int], None] | None = None, cancelled: Callable[[], bool] | None = None, group: str = "sceneql") -> list:
    """What the stages return, in order. progress(name, done, of) is called after each; where cancelled() is true before a
    stage, Cancelled is raised. All jobs carry the group, so that cancelJobGroup(group) from another thread stops a running one."""
    sc, made = spark.sparkContext, []
    try:
        for name, stage in stages:
            if cancelled is not None and cancelled():
                raise Cancelled(name)
            sc.setJobGroup(group, name, interruptOnCancel=True)
            made.append(stage())
            if progress is not None:
                progress(name, len(made), len(stages))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setJobDescription(None)
    return made
