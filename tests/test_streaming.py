"""Percentiles of streams against sorting all samples."""

import random

import pytest

from folioscope.functions.numbers import floor_rank
from folioscope.streaming import stateful as S


def test_percentiles_of_all_samples(spark, tmp_path):
    rng = random.Random(8)
    rows = [(s, rng.choice([None, float(rng.randrange(40)), rng.random() * 50])) for s, n in (("big", 14_000), ("one", 1), ("two", 2), (None, 30)) for _ in range(n)]
    rows += [("one", 5.0), ("empty", None), ("nan", float("nan")), ("nan", 1.0)]
    rng.shuffle(rows)
    cut = len(rows) // 2
    for i, part in enumerate((rows[:cut], rows[cut:])):
        spark.createDataFrame(part, "event_type string, value double").repartition(2).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        got = {r.stage: tuple(r)[1:] for r in S.all_percentiles(S.file_stream(spark, str(tmp_path), "events"), "event_type", "value", "file://" + str(tmp_path / "kept")).collect()}
        seen = rows[: (cut, len(rows))[i]]
        for stage in {s for s, v in seen if v is not None} - {"nan"}:
            own = [v for s, v in seen if s == stage and v is not None]
            assert got.pop(stage) == pytest.approx((len(own), floor_rank(own, 0.5), floor_rank(own, 0.95)))
        assert set(got) <= {"nan"}
    assert got["nan"][0] == 2 and got["nan"][1] != got["nan"][1]
