"""Scans by time of change: a changed file alone is parsed again."""

import json
import os

from pyspark.sql import functions as F

from talkloom.sources import incremental, scans


def test_only_changed_files_are_parsed_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "AT_ONCE", 2)
    root, store = tmp_path / "out", str(tmp_path / "store")

    def put(name, turns, at):
        (root / name).mkdir(parents=True, exist_ok=True)
        f = root / name / "result.json"
        f.write_text(json.dumps({"metadata": {"duration_ms": turns}, "turns": [{"turn_idx": i} for i in range(turns)]}) if turns is not None else "{broken")
        os.utime(f, (at, at))

    def scan(number):
        def parse(files):
            s = scans.summaries(files.withColumnRenamed("path", "name")).select(F.col("name").alias("path"), "turns")
            return s.withColumn("scan", F.lit(number))

        return {r.path.split("/")[-2]: (r.turns, r.scan) for r in incremental.refresh(spark, str(root), "result.json", store, number, parse).collect()}

    for i in range(5):
        put(f"m{i}", i, 1_700_000_000 + i)
    put("bad", None, 1_700_000_000)
    assert scan(0) == {f"m{i}": (i, 0) for i in range(5)}
    assert scan(1) == {f"m{i}": (i, 0) for i in range(5)}
    put("m2", 9, 1_700_000_500)
    put("m7", 7, 1_700_000_001)
    os.remove(root / "m0" / "result.json")
    want = {"m1": (1, 0), "m2": (9, 2), "m3": (3, 0), "m4": (4, 0), "m7": (7, 2)}
    assert scan(2) == want
    assert scan(2) == want  # repeated, after a crash
    assert scan(3) == want
