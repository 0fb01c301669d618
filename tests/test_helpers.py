"""Small rules and forms that no registered query shows in full."""

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from tarnlight.functions import rules as R
from tarnlight.operators import curation, reports
from tarnlight.sources import tables as S


def test_readings(spark):
    rows = [("low", 0.59, " ", "x"), ("moderate", 0.60, None, " y "), ("high", 0.75, "a", "b"), ("?", None, None, None)]
    df = spark.createDataFrame(rows, "level string, auc double, a string, b string")
    got = df.select(R.three_class(F.col("level")).alias("c"), R.auc_reading(F.col("auc")).alias("r"), R.first_filled(F.col("a"), F.col("b")).alias("f"), R.stem(F.col("level")).alias("s")).collect()
    assert [r.c for r in got] == [0, 1, 2, None]
    assert [r.r for r in got[:3]] == ["near chance", "weak", "useful"]
    assert [r.f for r in got] == ["x", "y", "a", None]
    assert [r.s for r in got] == [hashlib.sha1(x[0].encode()).hexdigest()[:12] for x in rows]


def test_labels_and_one_row(spark):
    df = spark.createDataFrame([(1, "0"), (2, "2.0"), (3, "3"), (4, "x"), (5, None), (6, "")], "id long, label string")
    assert {(r.id, r.label) for r in curation.valid_labels(df, "label").collect()} == {(1, 0), (2, 2)}
    assert [r.id for r in reports.get_by_id(df, "id", 3).collect()] == [3]
    assert reports.get_by_id(df, "id", 9).count() == 0


def test_report_payload(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    row = (1, 2, "sewage", 61.5, "high", at, "done", 0.1, True, "high", "watch", "cached_lake", None)
    schema = "report_id long, water_body_id long, contamination_type string, composite_score double, risk_level string, created_at timestamp, satellite_status string, satellite_ndci double, satellite_exceeds_clean_baseline boolean, satellite_spatial_confidence string, satellite_corroboration string, satellite_mode string, satellite_checked_at timestamp"
    got = reports.report_payload(spark.createDataFrame([row], schema)).first()
    assert got.created_at == "2024-01-02T03:04:05"
    assert got.satellite_verdict.asDict() == {"status": "done", "ndci": 0.1, "exceeds_clean_baseline": True, "spatial_confidence": "high", "corroboration": "watch", "mode": "cached_lake", "checked_at": None}


def test_sorted_csv(spark, tmp_path):
    S.write_sorted_csv(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k long, v string"), f"{tmp_path}/out", "k")
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert [x for x in lines if x != "k,v"] == ["1,a", "2,b", "3,c"]
    assert "k,v" in lines
