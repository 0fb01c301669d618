"""Rules at every boundary."""

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import rules as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("score", "level"), [(0.0, "low"), (15.0, "low"), (15.01, "moderate"), (35.0, "moderate"), (35.01, "high"), (None, None)])
def test_risk_level(spark, score, level):
    assert value(spark, R.risk_level(F.lit(score).cast("double"))) == level


def test_composite_worked_example(spark):
    got = value(spark, R.composite(*[F.lit(x) for x in (4.6, 0.28, 68.6, 100.0, 2.57, 11.0, 10.7)]))
    assert got.composite_score == 10.0
    assert got.risk_level == "low"
    assert [round(x, 2) for x in got.breakdown] == [0.69, 0.05, 5.65, 0.0, 0.18, 1.65, 1.82]


def test_composite_clamps_inputs(spark):
    got = value(spark, R.composite(*[F.lit(x) for x in (500.0, -3.0, 100.0, 100.0, 0.0, 0.0, 0.0)]))
    assert got.composite_score == 15.0
    assert got.risk_level == "low"


@pytest.mark.parametrize(
    ("score", "pred", "conf", "second", "second_conf", "third", "want"),
    [
        (10.0, "bad", 0.8, None, 0.9, None, 30.0), (10.0, "bad", 0.70, None, 0.9, None, 10.0), (10.0, "bad", 0.8, "polluted", 0.5, None, 45.0),
        (10.0, "bad", 0.8, "turbid", 0.5, 0.6, 46.5), (10.0, "bad", 0.8, "turbid", 0.5, 0.5, 37.5), (95.0, "bad", 0.8, "polluted", 1.0, None, 100.0),
        (10.0, "good", 0.86, "polluted", 0.9, None, 10.0), (10.0, "good", 0.85, "polluted", 0.9, None, 28.0), (10.0, "good", 0.6, "turbid", 0.8, None, 18.0),
        (10.0, "good", 0.6, "turbid", 0.7, None, 10.0), (10.0, None, None, "polluted", 0.9, None, 28.0),
    ],
)
def test_fusion(spark, score, pred, conf, second, second_conf, third, want):
    lit = lambda x, t: F.lit(x).cast(t)
    got = R.fuse(lit(score, "double"), lit(pred, "string"), lit(conf, "double"), lit(conf, "double"), lit(second, "string"), lit(second_conf, "double"), lit(third, "double"))
    assert value(spark, got) == pytest.approx(want)


@pytest.mark.parametrize(("score", "foam", "debris", "algae", "want"), [(35.9, 31.0, 0.0, 0.0, 40.7), (36.0, 90.0, 90.0, 90.0, 36.0), (10.0, 30.0, 30.0, 50.0, 10.0), (10.0, 0.0, 0.0, 51.0, 36.0)])
def test_safety_net(spark, score, foam, debris, algae, want):
    assert value(spark, R.safety_net(*[F.lit(x) for x in (score, foam, debris, algae)])) == pytest.approx(want)


def test_forel_ule(spark):
    assert value(spark, R.fu_quality(F.lit(1))) == 100.0
    assert value(spark, R.fu_quality(F.lit(99))) == 0.0
    assert value(spark, R.fu_name(F.lit(22))) == "Unknown"
    assert value(spark, R.fu_name(F.lit(21))) == "Near Black"
    assert value(spark, R.fu_category(F.lit(19))) == "critical"
    assert value(spark, R.nearest_fu(F.lit(29.0), F.lit(98.0), F.lit(152.0))) == 1


@pytest.mark.parametrize(("votes", "want"), [([0, 2, None], 2), ([0, 0, 2], 0), ([0, 1, 2], 2), ([None, None, None], None), ([1, None, None], 1)])
def test_majority(spark, votes, want):
    assert value(spark, R.majority(F.array(*[F.lit(v).cast("int") for v in votes]))) == want


def test_votes_and_labels(spark):
    assert value(spark, R.vote(F.lit(" 2.0 "))) == 2
    assert value(spark, R.vote(F.lit("EXCLUDE"))) is None
    none = F.lit(None).cast("int")
    assert value(spark, R.final_label(F.lit(7), none, F.array(none))) is None
    assert value(spark, R.final_label(none, F.lit(1), F.array(F.lit(2)))) == 1


@pytest.mark.parametrize(("a", "b", "want"), [(True, True, "elevated"), (True, False, "watch"), (None, True, "watch"), (None, None, "nominal")])
def test_corroboration(spark, a, b, want):
    assert value(spark, R.corroboration(F.lit(True), F.lit(a).cast("boolean"), F.lit(b).cast("boolean"))) == want
    assert value(spark, R.corroboration(F.lit(None).cast("boolean"), F.lit(True), F.lit(True))) == "unavailable"


def test_badge_differs_from_verdict(spark):
    s = lambda x, t="string": F.lit(x).cast(t)
    assert value(spark, R.badge(s("done"), s("high"), s(False, "boolean"), s("watch"))) == "nominal"
    assert value(spark, R.badge(s("done"), s("low"), s(True, "boolean"), s("elevated"))) == "unavailable"
    assert value(spark, R.badge(s("done"), s(None), s(True, "boolean"), s("elevated"))) == "elevated"
    assert value(spark, R.badge(s("pending"), s(None), s(None, "boolean"), s(None))) == "processing"


def test_names_and_codes(spark):
    assert value(spark, R.lake_key(F.lit("  Powai   Lake "))) == "powai"
    assert value(spark, R.slug(F.lit("--A b!c-"))) == "a_b_c"
    assert value(spark, R.hex_code(F.lit("ffffffffffffffff"))) == -1
    assert value(spark, R.hex_code(F.lit("nope"))) == 0
    assert value(spark, R.code_hex(F.lit(-1))) == "f" * 16
    assert value(spark, R.hamming(F.lit(0), F.lit(-1))) == 64
    assert value(spark, R.unnamed(F.lit(12.0), F.lit(77.12345))) == "Unnamed Water Body (12.0000, 77.1235)"
    assert value(spark, R.strip_tags(F.lit(" <b>x</b> y "))) == "x y"


def test_detections(spark):
    found = F.expr("array(named_struct('class','algae','confidence',0.5D), named_struct('class','clean','confidence',0.9D), named_struct('class','polluted','confidence',0.9D))")
    assert value(spark, R.top_detection(found))["class"] == "clean"
    assert value(spark, R.pollution_confidence(found)) == 0.9
    assert value(spark, R.class_counts(found)) == {"algae": 1, "clean": 1, "polluted": 1}
    empty = found.cast("array<struct<class:string,confidence:double>>")
    assert value(spark, R.pollution_confidence(F.filter(empty, lambda d: F.lit(False)))) == 0.0


def test_thresholds_and_conclusions(spark):
    assert value(spark, R.meets_threshold(F.lit("odd"), F.lit("low"))) is True
    assert value(spark, R.meets_threshold(F.lit("moderate"), F.lit("odd"))) is False
    assert value(spark, R.leakage_level(F.lit(0.0))) == "NONE"
    assert value(spark, R.leakage_level(F.lit(10.5))) == "SEVERE"
    assert value(spark, R.baseline_ratio(F.lit(1.0), F.lit(1e-7))) is None
    assert "less than 2" in value(spark, R.audit_conclusion(F.lit("NONE"), F.lit(0.99), F.lit(0.98)))
    assert value(spark, R.audit_conclusion(F.lit(None).cast("string"), F.lit(0.9), F.lit(0.9))) == "Not run."
