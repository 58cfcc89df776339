"""Stage manifests: run a stage only where its configuration, inputs or outputs have changed."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sceneql.sources.atomic import current, exists, replace


def config_hash(config: dict, parent: str = "") -> str:
    """SHA-256 of sorted compact JSON; a child's hash holds its parent's, so a change above forces what is below."""
    return hashlib.sha256((parent + json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()


class Manifest:
    """One JSON row a finished stage under a folder that any of Spark's file systems can hold."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entry(self, stage: str) -> dict | None:
        path = current(self.spark, f"{self.folder}/_{stage}")
        if not exists(self.spark, path):
            return None
        rows = self.spark.read.schema("stage string, hash string, status string, seconds double").json(path).collect()
        return rows[0].asDict() if rows else None

    def valid(self, stage: str, hash_: str) -> bool:
        """Complete, of the same configuration, and its output is there."""
        e = self.entry(stage)
        return bool(e and e["status"] == "complete" and e["hash"] == hash_ and exists(self.spark, f"{self.folder}/{stage}/_SUCCESS"))

    def _write(self, stage: str, hash_: str, status: str, seconds: float) -> None:
        row = self.spark.createDataFrame([(stage, hash_, status, seconds)], "stage string, hash string, status string, seconds double")
        replace(self.spark, f"{self.folder}/_{stage}", row.coalesce(1).write.json)

    def adopt(self, other: Manifest, stages: list[str]) -> None:
        """The complete stages of another folder as stages of this one, for a second upload of the same content: what is
        above need not run again, what depends on this folder's own settings does."""
        for stage in stages:
            e = other.entry(stage)
            if e and other.valid(stage, e["hash"]):
                replace(self.spark, f"{self.folder}/{stage}", self.spark.read.parquet(f"{other.folder}/{stage}").write.parquet)
                self._write(stage, e["hash"], "complete", e["seconds"])

    def run(self, stage: str, config: dict, make: Callable[[], DataFrame], parent: str = "") -> tuple[DataFrame, str]:
        """The stage's table, made or read again, and its hash for the stages below."""
        hash_ = config_hash({"stage": stage, **config}, parent)
        path = f"{self.folder}/{stage}"
        if not self.valid(stage, hash_):
            began = time.time()
            self._write(stage, hash_, "running", 0.0)
            try:
                replace(self.spark, path, lambda to: make().write.parquet(to))
            except Exception:
                self._write(stage, hash_, "failed", time.time() - began)
                raise
            self._write(stage, hash_, "complete", time.time() - began)
        return self.spark.read.parquet(path), hash_
