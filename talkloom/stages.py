"""Stage tables that are reused while their settings, and those of all stages before, stay the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class TransientFailure(Exception):
    """A stage's result that may be passed on, but not kept: the next run tries again."""

    def __init__(self, fallback: DataFrame):
        super().__init__("not kept")
        self.fallback = fallback


def fingerprints(stages: list[tuple[str, dict]]) -> dict[str, str]:
    """Stage -> fingerprint of its settings and the stage before it."""
    out, before = {}, ""
    for name, settings in stages:
        before = hashlib.sha256((before + json.dumps(settings, sort_keys=True, ensure_ascii=False)).encode()).hexdigest()[:16]
        out[name] = before
    return out


class StageTables:
    """Tables under root/stage/fingerprint. One counts only with its commit marker, so that a lost writer leaves nothing valid."""

    def __init__(self, spark: SparkSession, root: str, stages: list[tuple[str, dict]], force: bool = False):
        self.spark, self.root, self.force, self.prints = spark, root.rstrip("/"), force, fingerprints(stages)

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}/{self.prints[stage]}"

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def fresh(self, stage: str) -> bool:
        p, fs = self._files(self.path(stage) + "/_SUCCESS")
        return not self.force and fs.exists(p)

    def table(self, stage: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: kept from before, or built and kept. A transient failure's fallback is returned and not kept."""
        if not self.fresh(stage):
            try:
                build().write.mode("overwrite").parquet(self.path(stage))
            except TransientFailure as e:
                return e.fallback
        return self.spark.read.parquet(self.path(stage))

    def remove_stale(self, stage: str) -> int:
        """Deletes the stage's tables of other fingerprints."""
        p, fs = self._files(f"{self.root}/{stage}")
        old = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        old = [x for x in old if x.getName() != self.prints[stage]]
        for x in old:
            fs.delete(x, True)
        return len(old)
