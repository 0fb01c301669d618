"""Registered queries: the operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import fixed as K
from tarnlight.functions import rules as R
from tarnlight.operators import alerts, curation, evaluate, fingerprint, photo, reports, satellite, spatial
from tarnlight.plans.adapters import AS_OF, Tables, ctes
from tarnlight.scratch import materialize, new_path
from tarnlight.sources import tables
from tarnlight.streaming import enrichment, state, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _fu_quality(i: str) -> str:
    return f"round(100e0 - (least(21, greatest(1, {i})) - 1) / 20e0 * 100, 1)"


_CLAMP = "least(100e0, greatest(0e0, {}))".format
_PARTS = {
    "algae": f"{_CLAMP('algae_percentage')} * 0.15e0", "foam": f"{_CLAMP('foam_coverage_pct')} * 0.18e0", "turbidity": f"(100e0 - {_CLAMP('turbidity_score')}) * 0.18e0",
    "forel_ule": f"(100e0 - {_CLAMP(_fu_quality('forel_ule_index'))}) * 0.10e0", "oil_sheen": f"{_CLAMP('oil_coverage_pct')} * 0.07e0",
    "color_abnormality": f"{_CLAMP('color_abnormality_score')} * 0.15e0", "debris": f"{_CLAMP('debris_density')} * 0.17e0",
}
_LEVEL = "CASE WHEN {0} <= 15 THEN 'low' WHEN {0} <= 35 THEN 'moderate' ELSE 'high' END".format
_B = "round(least(100e0, {} + {}) + 1e-9, 1)".format
_FUSED = f"""CASE WHEN eff_prediction = 'bad' AND eff_confidence > 0.70e0 THEN
  CASE WHEN yolo_prediction = 'polluted' THEN {_B(_B('base', 'eff_confidence * 25'), 'yolo_confidence * 30')} WHEN yolo_prediction = 'turbid' THEN {_B(_B('base', 'eff_confidence * 25'), 'yolo_confidence * 15')} ELSE {_B('base', 'eff_confidence * 25')} END
 WHEN eff_prediction = 'good' AND eff_confidence > 0.85e0 THEN base
 WHEN yolo_prediction = 'polluted' AND yolo_confidence > 0.7e0 THEN {_B('base', 'yolo_confidence * 20')} WHEN yolo_prediction = 'turbid' AND yolo_confidence > 0.7e0 THEN {_B('base', 'yolo_confidence * 10')} ELSE base END"""
#: Reports with base, base_level, fused, score and level, as common table expressions.
SCORED = f"""WITH {ctes('v_reports', 'v_bodies')},
s0 AS (SELECT *, {_CLAMP(' + '.join(_PARTS.values()))} AS raw FROM v_reports),
s1 AS (SELECT *, round(raw + 1e-9, 1) AS base, {_LEVEL('raw')} AS base_level FROM s0),
s2 AS (SELECT *, {_FUSED} AS fused FROM s1),
s3 AS (SELECT *, CASE WHEN (foam_coverage_pct > 30 OR debris_density > 30 OR algae_percentage > 50) AND fused < 36
  THEN round(least(100e0, greatest(fused, 36e0 + foam_coverage_pct * 0.15e0 + debris_density * 0.1e0)) + 1e-9, 1) ELSE fused END AS score FROM s2),
scored AS (SELECT *, {_LEVEL('score')} AS level FROM s3)
"""
_AS_OF = f"TIMESTAMP '{AS_OF}'"


def _scored(t: Tables) -> DataFrame:
    return reports.scored(t["v_reports"])


# reports and bodies


@query(SCORED + f"""
SELECT b.id, coalesce(b.name, printf('Unnamed Water Body (%.4f, %.4f)', b.latitude, b.longitude)) AS name, b.city, b.state, coalesce(w.score, 0e0) AS current_risk_score,
 coalesce(w.level, 'low') AS current_risk_level, coalesce(w.n, 0) AS total_reports, coalesce(w.recent, 0) AS recent_reports
FROM v_bodies b LEFT JOIN (SELECT water_body_id, count(*) AS n, count(*) FILTER (WHERE created_at >= {_AS_OF} - INTERVAL 7 DAY) AS recent,
 arg_max(score, (created_at, report_id)) AS score, arg_max(level, (created_at, report_id)) AS level FROM scored GROUP BY 1) w ON w.water_body_id = b.id
ORDER BY current_risk_score DESC, b.id LIMIT 50""")
def top_risk_bodies(t: Tables) -> DataFrame:
    """The flagship list."""
    bodies = reports.bodies_with_state(t["v_bodies"], _scored(t), AS_OF)
    out = reports.body_payload(reports.top_risk(bodies, 50))
    return out.select("id", "name", "city", "state", "current_risk_score", "current_risk_level", "total_reports", "recent_reports")


@query(SCORED + "SELECT report_id, base AS base_score, base_level, fused AS fused_score, score AS composite_score, level AS risk_level, " + ", ".join(f"round({x} + 1e-9, 2) AS {k}_component" for k, x in _PARTS.items()) + " FROM scored")
def composite_scores(t: Tables) -> DataFrame:
    """F1-F4, F6, F8"""
    parts = [F.col(f"base.breakdown.{k}_component").alias(f"{k}_component") for k in K.WEIGHTS]
    return _scored(t).select("report_id", F.col("base.composite_score").alias("base_score"), F.col("base.risk_level").alias("base_level"), "fused_score", "composite_score", "risk_level", *parts)


@query(SCORED + """SELECT report_id, round(CASE WHEN eff_prediction = 'bad' AND eff_confidence > 0.70e0 THEN least(100e0, base + (eff_confidence * 25 +
 CASE yolo_prediction WHEN 'polluted' THEN yolo_confidence * 30 WHEN 'turbid' THEN yolo_confidence * 15 ELSE 0e0 END)) ELSE base END, 6) AS baseline_score FROM scored""")
def baseline_fusion(t: Tables) -> DataFrame:
    """F5"""
    c = F.col
    score = R.fuse_baseline(c("base.composite_score"), c("eff_prediction"), c("eff_confidence"), c("eff_confidence"), c("yolo_prediction"), c("yolo_confidence"))
    return _scored(t).select("report_id", F.round(score, 6).alias("baseline_score"))


@query(f"WITH {ctes('v_reports')} SELECT report_id, " + f"""{_fu_quality('forel_ule_index')} AS fu_quality,
 CASE WHEN forel_ule_index <= 3 THEN 'excellent' WHEN forel_ule_index <= 6 THEN 'good' WHEN forel_ule_index <= 10 THEN 'moderate' WHEN forel_ule_index <= 14 THEN 'poor' WHEN forel_ule_index <= 18 THEN 'very_poor' ELSE 'critical' END AS fu_category,
 {list(K.FU_NAMES)}[forel_ule_index] AS fu_name,
 CASE WHEN algae_percentage < 5 THEN 'none' WHEN algae_percentage < 20 THEN 'low' WHEN algae_percentage < 50 THEN 'moderate' ELSE 'heavy' END AS algae_severity,
 CASE WHEN debris_density > oil_coverage_pct AND debris_density > 2 THEN 'thick slick' WHEN oil_coverage_pct > 1 THEN 'rainbow sheen' ELSE 'none' END AS oil_type,
 CASE WHEN oil_coverage_pct < 1 THEN 'none' WHEN oil_coverage_pct < 5 THEN 'possible' ELSE 'likely' END AS oil_confidence,
 round(least(100e0, debris_density / 30e0 * 100) + 1e-9, 1) AS debris_score, least(100e0, debris_density / 30e0 * 100) >= 10 AS debris_detected,
 CASE WHEN least(100e0, debris_density / 30e0 * 100) < 10 THEN 'Clean Surface' WHEN least(100e0, debris_density / 30e0 * 100) < 30 THEN 'Some Debris' WHEN least(100e0, debris_density / 30e0 * 100) < 60 THEN 'Moderate Debris' ELSE 'Heavy Debris' END AS debris_description,
 upper(substr(replace(contamination_type, '_', ' '), 1, 1)) || substr(replace(contamination_type, '_', ' '), 2) AS title,
 CASE WHEN contamination_type LIKE '%e%' THEN 'Anonymous' ELSE contamination_type END AS reporter
FROM v_reports""")
def factor_rules(t: Tables) -> DataFrame:
    """F7-F10, F12, F14, F44"""
    c = F.col
    d = R.debris(c("debris_density"))
    return t["v_reports"].select(
        "report_id", R.fu_quality(c("forel_ule_index")).alias("fu_quality"), R.fu_category(c("forel_ule_index")).alias("fu_category"), R.fu_name(c("forel_ule_index")).alias("fu_name"),
        R.algae_severity(c("algae_percentage")).alias("algae_severity"), R.oil_type(c("debris_density"), c("oil_coverage_pct")).alias("oil_type"), R.oil_confidence(c("oil_coverage_pct")).alias("oil_confidence"),
        d["contour_density"].alias("debris_score"), d["debris_detected"].alias("debris_detected"), d["description"].alias("debris_description"),
        R.display_title(c("contamination_type")).alias("title"), R.reporter(F.when(c("contamination_type").contains("e"), " ").otherwise(c("contamination_type"))).alias("reporter"),
    )


@query(f"""WITH {ctes('v_reports')}, x AS (SELECT report_id, algae_percentage * 5e0 AS lap, foam_coverage_pct * 1.5e0 AS ss, debris_density * 1.5e0 AS vs, turbidity_score * 2e0 AS vm, foam_coverage_pct AS hs, oil_coverage_pct AS un FROM v_reports),
y AS (SELECT *, greatest(0e0, least(100e0, lap / 300e0 * 100) - (CASE WHEN ss > 40 THEN least(50e0, (ss - 40) * 1.5e0) ELSE 0e0 END + CASE WHEN vs > 50 THEN least(30e0, vs - 50) ELSE 0e0 END
 + CASE WHEN vm < 100 THEN least(40e0, (100e0 - vm) * 0.8e0) ELSE 0e0 END + CASE WHEN lap > 150 AND vm < 130 THEN 25e0 ELSE 0e0 END)) AS cl, greatest(0e0, 100e0 - hs / 60e0 * 100) AS uni FROM x),
z AS (SELECT *, least(100e0, greatest(0e0, (100e0 - uni) * 0.6e0 + least(un * 5, 100e0) * 0.4e0)) AS ab FROM y)
SELECT report_id, round(cl + 1e-9, 1) AS turbidity_score, CASE WHEN cl > 66 THEN 'Clear' WHEN cl > 33 THEN 'Moderately Turbid' ELSE 'Highly Turbid' END AS clarity_description,
 round(ab + 1e-9, 1) AS color_abnormality_score, round(uni + 1e-9, 1) AS color_uniformity, CASE WHEN ab < 20 THEN 'Normal' WHEN ab < 50 THEN 'Slightly Abnormal' ELSE 'Highly Abnormal' END AS description FROM z""")
def clarity_and_colour(t: Tables) -> DataFrame:
    """F11, F13"""
    c = F.col
    cl = R.clarity(c("algae_percentage") * 5.0, c("foam_coverage_pct") * 1.5, c("debris_density") * 1.5, c("turbidity_score") * 2.0)
    ab = R.color_abnormality(c("foam_coverage_pct"), c("oil_coverage_pct"))
    return t["v_reports"].select("report_id", cl.alias("cl"), ab.alias("ab")).select("report_id", "cl.*", "ab.*")


#: What the views don't have: images, and places off the map.
_SENT = """SELECT * REPLACE (latitude + CASE WHEN report_id % 83 = 0 THEN 90e0 ELSE 0e0 END AS latitude, longitude - CASE WHEN report_id % 89 = 0 THEN 270e0 ELSE 0e0 END AS longitude),
 CASE WHEN report_id % 23 = 0 THEN 'image/gif' WHEN report_id % 29 = 0 THEN NULL ELSE 'image/jpeg' END AS mime_type,
 CASE WHEN report_id % 31 = 0 THEN 0 WHEN report_id % 37 = 0 THEN NULL ELSE 1000 + (report_id % 41) * 500000 END AS size_bytes FROM v_reports"""


@query(f"""WITH {ctes('v_reports')}, s AS ({_SENT}) SELECT CASE WHEN latitude > 90 THEN 'latitude out of range' WHEN longitude < -180 THEN 'longitude out of range'
 WHEN contamination_type NOT IN {K.CONTAMINATION_TYPES} THEN 'unknown contamination type' WHEN mime_type IS NULL OR mime_type NOT IN {tuple(K.MIME_TYPES)} THEN 'unsupported image type'
 WHEN size_bytes > {K.MAX_BYTES} THEN 'image too large' WHEN coalesce(size_bytes, 0) = 0 THEN 'empty image' ELSE 'ok' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def validation(t: Tables) -> DataFrame:
    """P1, all six reasons"""
    i, c = F.col("report_id"), F.col
    sent = t["v_reports"].withColumns({
        "latitude": c("latitude") + F.when(i % 83 == 0, 90.0).otherwise(0.0), "longitude": c("longitude") - F.when(i % 89 == 0, 270.0).otherwise(0.0),
        "mime_type": F.when(i % 23 == 0, "image/gif").when(i % 29 != 0, "image/jpeg"),
        "size_bytes": F.when(i % 31 == 0, 0).when(i % 37 != 0, 1000 + (i % 41) * 500000),
    })
    good, bad = reports.validate(sent)
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select(F.col("reject_reason").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {ctes('v_reports')} SELECT water_body_id, " + ", ".join(f"count(*) FILTER (WHERE contamination_type = '{k}') AS {k}" for k in K.CONTAMINATION_TYPES) + " FROM v_reports GROUP BY 1")
def contamination_breakdown(t: Tables) -> DataFrame:
    """A3"""
    return reports.breakdown(t["v_reports"]).drop("breakdown")


@query(SCORED + "SELECT level AS risk_level, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM scored), 1) AS pct FROM scored GROUP BY 1")
def level_distribution(t: Tables) -> DataFrame:
    """A4, A1"""
    return reports.level_distribution(_scored(t))


@query(f"WITH {ctes('v_bodies')} SELECT min(latitude) AS min_latitude, max(latitude) AS max_latitude, min(longitude) AS min_longitude, max(longitude) AS max_longitude FROM v_bodies")
def map_extent(t: Tables) -> DataFrame:
    """A5"""
    return reports.extent(t["v_bodies"])


@query(SCORED + """SELECT min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.25) AS p25,
 quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90 FROM scored""")
def score_distribution(t: Tables) -> DataFrame:
    """A12"""
    return reports.score_distribution(_scored(t))


@query(SCORED + """SELECT quantile_cont(score, 0.2) AS suggested_low, quantile_cont(score, 0.5) + 15 AS suggested_moderate, avg((level = 'low')::INT) * 100 > 20 AS too_many_low,
 CASE WHEN avg((level = 'low')::INT) * 100 > 20 THEN quantile_cont(score, 0.15) END AS lower_limit_to FROM scored""")
def threshold_advice(t: Tables) -> DataFrame:
    """F38"""
    q = F.expr("percentile(composite_score, array(0.15D, 0.2D, 0.5D))")
    d = _scored(t).agg(q.alias("q"), (F.avg((F.col("risk_level") == "low").cast("double")) * 100).alias("low"))
    return reports.threshold_advice(d.select(F.col("q")[0].alias("p15"), F.col("q")[1].alias("p20"), F.col("q")[2].alias("p50"), "low"), F.col("low"))


@query(f"WITH {ctes('v_reports')}, x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM v_reports" for f in reports.FEATURES) + """)
SELECT feature, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std, max(value) AS max, row_number() OVER (ORDER BY avg(value) DESC, feature) AS rank FROM x GROUP BY 1""")
def feature_statistics(t: Tables) -> DataFrame:
    """A13"""
    return reports.feature_stats(t["v_reports"])


@query(f"""WITH {ctes('v_reports')} SELECT contamination_type AS category, round(avg(algae_percentage), 1) AS algae, round(avg(foam_coverage_pct), 1) AS foam, round(avg(100 - turbidity_score), 1) AS turbidity,
 round(avg(oil_coverage_pct), 1) AS oil, round(avg(color_abnormality_score), 1) AS color_abnormality, round(avg(debris_density), 1) AS debris, round(avg(forel_ule_index), 1) AS fu_index FROM v_reports GROUP BY 1""")
def detector_matrix(t: Tables) -> DataFrame:
    """A14"""
    return reports.detector_matrix(t["v_reports"])


@query(f"""WITH {ctes('v_reports')}, m AS (SELECT contamination_type AS category, round(avg(algae_percentage), 1) AS algae, round(avg(foam_coverage_pct), 1) AS foam, round(avg(100 - turbidity_score), 1) AS turbidity,
 round(avg(oil_coverage_pct), 1) AS oil, round(avg(color_abnormality_score), 1) AS color_abnormality, round(avg(debris_density), 1) AS debris FROM v_reports GROUP BY 1),
l AS (UNPIVOT m ON algae, foam, turbidity, oil, color_abnormality, debris INTO NAME detector VALUE value),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY value DESC, detector) AS r FROM l),
e(category, expected) AS (VALUES ('sewage', ['color_abnormality', 'turbidity']), ('oil_spill', ['oil']), ('foam', ['algae', 'foam']), ('solid_waste', ['debris']))
SELECT category, string_agg(detector, ',' ORDER BY r) AS top2, bool_or(list_contains(expected, detector)) AS match FROM r JOIN e USING (category) WHERE r <= 2 GROUP BY 1""")
def detector_hits(t: Tables) -> DataFrame:
    """W9, J16, with the reports' own categories"""
    names = {"sewage": "sewage", "oil_spill": "oily_chemical", "foam": "algal_foam", "solid_waste": "garbage"}
    expected = t.spark.createDataFrame([(a, list(K.EXPECTED_DETECTORS[b])) for a, b in names.items()], "category string, expected array<string>")
    found = reports.detector_hits(reports.detector_matrix(t["v_reports"]), expected)
    return found.select("category", F.array_join("top2", ",").alias("top2"), "match")


@query(SCORED + """SELECT water_body_id, arg_max(report_id, (created_at, report_id)) AS report_id, arg_max(contamination_type, (created_at, report_id)) AS contamination_type,
 arg_max(score, (created_at, report_id)) AS composite_score, max(created_at) AS created_at FROM scored GROUP BY 1""")
def latest_reports(t: Tables) -> DataFrame:
    """W1"""
    a = F.col("latest_analysis")
    return reports.latest_report(_scored(t)).select("water_body_id", *[a[c].alias(c) for c in ("report_id", "contamination_type", "composite_score", "created_at")])


@query(SCORED + "SELECT report_id, score AS composite_score, created_at FROM scored ORDER BY created_at DESC, report_id DESC LIMIT 100 OFFSET 40")
def report_page(t: Tables) -> DataFrame:
    """A page's limit is a feature; 500 are asked for and 100 are the most"""
    return reports.page(_scored(t).select("report_id", "composite_score", "created_at"), "created_at", 500, 40)


@query(SCORED + "SELECT report_id, score AS composite_score, created_at, (SELECT count(*) FROM scored) AS total FROM scored ORDER BY created_at DESC, report_id DESC LIMIT 100 OFFSET 200")
def report_page_by_cursor(t: Tables) -> DataFrame:
    """The third page, reached by the cursors of the first two"""
    rows, cursor = _scored(t).select("report_id", "composite_score", "created_at"), None
    for _ in range(2):
        _, cursor = reports.page_after(rows, "created_at", cursor, 100)
    return reports.page_after(rows, "created_at", cursor, 100)[0]


@query(SCORED + """SELECT water_body_id::VARCHAR AS water_body_id, count(*) AS total_reports, max(created_at) AS last_report_at,
 arg_max(score, (created_at, report_id)) AS current_risk_score, arg_max(level, (created_at, report_id)) AS current_risk_level FROM scored GROUP BY 1""")
def kept_body_state(t: Tables) -> DataFrame:
    """The state after three batches, the second of them taken in twice"""
    path, rows = new_path(t.spark, "state"), materialize(_scored(t).select("report_id", "water_body_id", "created_at", "composite_score", "risk_level"), "scored")
    for k in (0, 1, 1, 2):
        state.merge_batch(rows.where(F.pmod("report_id", F.lit(3)) == k), path, k)
    return state.current_state(t.spark, path).withColumn("last_report_at", F.col("last_report_at").cast(rows.schema["created_at"].dataType))


@query(SCORED + f"""SELECT water_body_id, strftime(created_at, '%Y-%m-%d') AS date, score AS risk_score FROM scored WHERE created_at >= {_AS_OF} - INTERVAL 10 DAY""")
def risk_history(t: Tables) -> DataFrame:
    """W4"""
    return reports.history(_scored(t), AS_OF, 10).select("water_body_id", "date", F.col("composite_score").alias("risk_score"))


@query(SCORED + "SELECT water_body_id, report_id, position FROM (SELECT *, row_number() OVER (PARTITION BY water_body_id ORDER BY created_at DESC, report_id DESC) AS position FROM scored) x WHERE position <= 5")
def last_reports(t: Tables) -> DataFrame:
    """W5"""
    return reports.last_k(t["v_reports"], 5).select("water_body_id", "report_id", "position")


@query(SCORED + """SELECT report_id, water_body_id, score AS risk_score, level AS risk_level, algae_percentage AS avg_algae_pct, foam_coverage_pct AS avg_foam_coverage, turbidity_score AS avg_turbidity,
 row_number() OVER (PARTITION BY water_body_id ORDER BY created_at, report_id) AS report_count, created_at AS window_start, created_at AS window_end FROM scored""")
def risk_snapshots(t: Tables) -> DataFrame:
    """W6"""
    return reports.snapshots(_scored(t))


@query(SCORED + f"""SELECT report_id, CASE WHEN date_diff('second', created_at, {_AS_OF}) < 60 THEN date_diff('second', created_at, {_AS_OF}) || 's ago'
 WHEN date_diff('second', created_at, {_AS_OF}) < 3600 THEN date_diff('second', created_at, {_AS_OF}) // 60 || 'm ago'
 WHEN date_diff('second', created_at, {_AS_OF}) < 86400 THEN date_diff('second', created_at, {_AS_OF}) // 3600 || 'h ago' ELSE date_diff('second', created_at, {_AS_OF}) // 86400 || 'd ago' END AS age,
 strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS at FROM scored WHERE level = 'high'""")
def report_ages(t: Tables) -> DataFrame:
    """F24, P3, P5"""
    now = F.lit(AS_OF).cast("timestamp")
    return reports.with_status(_scored(t).withColumn("status", F.col("risk_level")), "high").select("report_id", R.relative_age(F.date_trunc("second", "created_at"), now).alias("age"), reports.iso(F.col("created_at")).alias("at"))


# spatial

_HAV = "2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))".format
_D = _HAV(a="r.latitude", b="r.longitude", c="b.latitude", d="b.longitude")


@query(f"""WITH {ctes('v_reports', 'v_bodies')}, d AS (SELECT report_id, b.id, {_D} AS distance FROM v_reports r JOIN v_bodies b ON abs(r.latitude - b.latitude) < 0.01e0 AND {_D} <= 500),
n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY distance, id) AS k FROM d) SELECT report_id, id AS body_id, round(distance, 1) AS distance FROM n WHERE k = 1""")
def nearest_body(t: Tables) -> DataFrame:
    """J1, F46"""
    return spatial.nearest_within(t["v_reports"], t["v_bodies"]).withColumn("distance", F.round("distance", 1))


_FOUNDED = _HAV(a="f.latitude", b="f.longitude", c="m.latitude", d="m.longitude")


# places without a known body near, in their turn; those of the reports that found a body are gathered one step after the other
@query(f"""WITH RECURSIVE {ctes('v_reports', 'v_bodies')}, d AS (SELECT report_id, b.id, b.name, {_D} AS distance FROM v_reports r JOIN v_bodies b ON abs(r.latitude - b.latitude) < 0.01e0 AND {_D} <= 500),
hit AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY distance, id) AS k FROM d),
led AS (SELECT latitude, longitude, min((created_at, report_id)) AS first FROM v_reports WHERE report_id NOT IN (SELECT report_id FROM hit) GROUP BY 1, 2),
m AS (SELECT latitude, longitude, first[2] AS report_id, row_number() OVER (ORDER BY first, latitude, longitude) AS n FROM led),
w AS (SELECT 0::BIGINT AS n, []::STRUCT(n BIGINT, report_id BIGINT, latitude DOUBLE, longitude DOUBLE)[] AS made UNION ALL
 SELECT m.n, CASE WHEN len(list_filter(w.made, lambda f: {_FOUNDED} <= 500)) > 0 THEN w.made ELSE list_append(w.made, {{'n': m.n, 'report_id': m.report_id, 'latitude': m.latitude, 'longitude': m.longitude}}) END FROM w JOIN m ON m.n = w.n + 1),
f AS (SELECT unnest(made, recursive := true) FROM (SELECT made FROM w ORDER BY n DESC LIMIT 1)),
near AS (SELECT m.latitude, m.longitude, f.report_id AS founder, f.latitude AS flat, f.longitude AS flon, {_FOUNDED} AS distance, row_number() OVER (PARTITION BY m.latitude, m.longitude ORDER BY {_FOUNDED}, f.n) AS k FROM m JOIN f ON f.n <= m.n AND {_FOUNDED} <= 500)
SELECT report_id, id::VARCHAR AS body_id, name AS body_name, round(distance, 1) AS distance FROM hit WHERE k = 1
UNION ALL SELECT r.report_id, 'new-' || founder, printf('Unnamed Water Body (%.4f, %.4f)', flat, flon), round(distance, 1) FROM v_reports r JOIN near ON near.latitude = r.latitude AND near.longitude = r.longitude AND k = 1
WHERE r.report_id NOT IN (SELECT report_id FROM hit)""")
def resolved_bodies(t: Tables) -> DataFrame:
    """J2, J1"""
    return spatial.resolve_bodies(t["v_reports"], t["v_bodies"]).select("report_id", "body_id", "body_name", F.round("distance", 1).alias("distance"))


def _located_pixels(t: Tables) -> DataFrame:
    """Pixels around the bodies of their lakes, some metres apart."""
    p = t["v_pixels"]
    lat = F.lit(12.9) + (F.col("lake_id") % 40) * 0.01 + (F.col("pixel_id") % 7 - 3) * 0.0009
    return p.withColumn("latitude", lat).withColumn("longitude", F.lit(77.5) + (F.col("lake_id") % 37) * 0.01 + (F.col("pixel_id") % 5 - 2) * 0.0009)


_LOCATED = "SELECT *, 12.9e0 + (lake_id % 40) * 0.01e0 + (pixel_id % 7 - 3) * 0.0009e0 AS latitude, 77.5e0 + (lake_id % 37) * 0.01e0 + (pixel_id % 5 - 2) * 0.0009e0 AS longitude FROM v_pixels"
_POINT_END = "1997-06-01"


POINTS = f"""px AS ({_LOCATED}),
s AS (SELECT r.*, b.id, {_D} AS distance FROM px r JOIN v_bodies b ON abs(r.latitude - b.latitude) < 0.01e0 AND {_D} <= 500
 WHERE cloudy_pct < 80 AND sensed_date >= DATE '{_POINT_END}' - INTERVAL 180 DAY AND sensed_date < DATE '{_POINT_END}'),
e AS (SELECT s.*, buf FROM s, (VALUES (150), (300), (500)) v(buf) WHERE buf >= distance),
n AS (SELECT id, buf, count(DISTINCT scene_id) AS n_scenes FROM e GROUP BY 1, 2),
c AS (SELECT id, buf, pixel_id, quantile_cont(b3, 0.5) AS b3, quantile_cont(b4, 0.5) AS b4, quantile_cont(b5, 0.5) AS b5, quantile_cont(b8, 0.5) AS b8 FROM e WHERE scl NOT IN {K.MASKED_SCL} GROUP BY 1, 2, 3),
w AS (SELECT id, buf, avg((b5 - b4) / (b5 + b4)) AS ndci, count(*) AS px FROM c WHERE (b3 - b8) / (b3 + b8) > 0 GROUP BY 1, 2),
g AS (SELECT id, buf, ndci, px, n_scenes, row_number() OVER (PARTITION BY id ORDER BY buf) AS k FROM w JOIN n USING (id, buf) WHERE px >= 5)
SELECT b.id, g.id IS NOT NULL AS available, round(g.ndci, 4) AS live_ndci, g.px AS water_pixel_count, g.buf AS buffer_m,
 CASE WHEN g.buf <= 150 THEN 'high' WHEN g.buf <= 300 THEN 'medium' WHEN g.buf IS NOT NULL THEN 'low' END AS spatial_confidence, g.n_scenes AS scenes_used,
 CASE WHEN g.id IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.id = b.id) THEN 'sub_pixel_or_no_water' ELSE 'cloud_cover_or_timeout' END END AS reason
FROM v_bodies b LEFT JOIN g ON g.id = b.id AND k = 1"""


@query(f"WITH {ctes('v_bodies', 'v_pixels')}, {POINTS}")
def point_metrics(t: Tables) -> DataFrame:
    """J6, A11, F18, F19"""
    return spatial.point_metrics(t["v_bodies"], _located_pixels(t), f"{_POINT_END} 00:00:00")


def _pixels_by_place(t: Tables) -> DataFrame:
    """How many pixels lie at a place; a place is looked up once."""
    px = _located_pixels(t).select("lake_id", "pixel_id", "latitude", "longitude").distinct()
    return px.groupBy("latitude", "longitude").agg(F.count("*").alias("pixels"))


def _regions(t: Tables) -> DataFrame:
    """A triangle around each body."""
    c = F.col
    ring = F.array(F.array(c("longitude") - 0.004, c("latitude") - 0.003), F.array(c("longitude") + 0.004, c("latitude") - 0.003), F.array(c("longitude"), c("latitude") + 0.004))
    return t["v_bodies"].select(c("id").cast("string").alias("name"), F.lit("moderate").alias("category"), F.array(ring).alias("rings"))


def _holed_regions(t: Tables) -> DataFrame:
    """Of each body two parts: a square with a square hole, and a smaller square to its right; written as GeoJSON and read back."""
    c = F.col
    square = lambda x, r: F.array(*[F.array(c("longitude") + x + a * r, c("latitude") + b * r) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    parts = F.array(F.array(square(0.0, 0.003), square(0.0, 0.001)), F.array(square(0.0045, 0.001)))
    properties = F.struct(c("id").cast("string").alias("name"), F.lit(None).cast("string").alias("category"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")).alias("geometry"))
    path = new_path(t.spark, "regions")
    t["v_bodies"].groupBy(F.pmod("id", F.lit(8)).alias("k")).agg(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")).repartition("k").write.partitionBy("k").json(path)  # a file holds one collection
    return tables.read_regions(t.spark, path)


@query(f"""WITH {ctes('v_bodies', 'v_pixels')}, px AS (SELECT DISTINCT lake_id, pixel_id, latitude, longitude FROM ({_LOCATED}) y),
x AS (SELECT b.id, p.longitude - b.longitude AS u, p.latitude - b.latitude AS v FROM px p JOIN v_bodies b ON abs(p.latitude - b.latitude) < 0.01e0 AND abs(p.longitude - b.longitude) < 0.01e0)
SELECT CAST(id AS VARCHAR) AS name, 'unknown' AS category, count(*) AS pixels FROM x WHERE (greatest(abs(u), abs(v)) < 0.003e0 AND greatest(abs(u), abs(v)) > 0.001e0) OR greatest(abs(u - 0.0045e0), abs(v)) < 0.001e0 GROUP BY 1""")
def pixels_in_holed_regions(t: Tables) -> DataFrame:
    """Polygons with holes and several parts, from a GeoJSON file"""
    return spatial.in_region(_pixels_by_place(t), _holed_regions(t)).groupBy("name", "category").agg(F.sum("pixels").alias("pixels"))


@query(f"""WITH {ctes('v_bodies', 'v_pixels')}, px AS (SELECT DISTINCT lake_id, pixel_id, latitude, longitude FROM ({_LOCATED}) y),
x AS (SELECT b.id, p.longitude - b.longitude AS u, p.latitude - b.latitude AS v FROM px p JOIN v_bodies b ON abs(p.latitude - b.latitude) < 0.01e0 AND abs(p.longitude - b.longitude) < 0.01e0)
SELECT CAST(id AS VARCHAR) AS name, count(*) AS pixels FROM x WHERE v > -0.003e0 AND v < 0.004e0 AND abs(u) < 0.004e0 * (0.004e0 - v) / 0.007e0 GROUP BY 1""")
def pixels_in_regions(t: Tables) -> DataFrame:
    """J7, S5's shape of regions"""
    return spatial.in_region(_pixels_by_place(t), _regions(t)).groupBy("name").agg(F.sum("pixels").alias("pixels"))


# satellite

MONTHLY = f"""WITH {ctes('v_pixels')}, s AS (SELECT *, strftime(sensed_date, '%Y-%m') AS date FROM v_pixels WHERE cloudy_pct < 20),
n AS (SELECT lake_id, date, count(DISTINCT scene_id) AS n_scenes FROM s GROUP BY 1, 2),
c AS (SELECT lake_id, date, pixel_id, quantile_cont(b3, 0.5) AS b3, quantile_cont(b4, 0.5) AS b4, quantile_cont(b5, 0.5) AS b5, quantile_cont(b8, 0.5) AS b8 FROM s WHERE scl NOT IN {K.MASKED_SCL} GROUP BY 1, 2, 3),
w AS (SELECT lake_id, date, avg((b5 - b4) / (b5 + b4)) AS ndci_mean, count(*) AS water_px FROM c WHERE (b3 - b8) / (b3 + b8) > 0 GROUP BY 1, 2),
months AS (SELECT strftime(m, '%Y-%m') AS date FROM (SELECT unnest(generate_series(date_trunc('month', min(sensed_date)), date_trunc('month', max(sensed_date)), INTERVAL 1 MONTH)) AS m FROM v_pixels) x),
lakes AS (SELECT lake_id, min(category) AS category FROM v_pixels GROUP BY 1),
monthly AS (SELECT lake_id, category, date, ndci_mean, coalesce(water_px, 0) AS water_px, coalesce(n_scenes, 0) AS n_scenes FROM lakes CROSS JOIN months LEFT JOIN n USING (lake_id, date) LEFT JOIN w USING (lake_id, date)),
summary AS (SELECT lake_id, category, count(*) AS n_months, round(avg(ndci_mean), 4) AS ndci_mean, round(quantile_cont(ndci_mean, 0.5), 4) AS ndci_median, round(quantile_cont(ndci_mean, 0.75), 4) AS ndci_p75,
 round(arg_max(ndci_mean, date), 4) AS ndci_latest, max(date) AS latest_date FROM monthly WHERE ndci_mean IS NOT NULL GROUP BY 1, 2),
base AS (SELECT coalesce(avg(ndci_p75) FILTER (WHERE category = 'clean_reference'), 0.015e0) AS clean_baseline FROM summary),
verdict AS (SELECT *, ndci_latest > ndci_p75 AS self_anomaly, ndci_latest > clean_baseline AS exceeds_clean_baseline, CASE WHEN abs(clean_baseline) > 1e-6 THEN round(ndci_latest / clean_baseline, 3) END AS vs_clean_ratio,
 CASE WHEN ndci_latest > ndci_p75 AND ndci_latest > clean_baseline THEN 'elevated' WHEN ndci_latest > ndci_p75 OR ndci_latest > clean_baseline THEN 'watch' ELSE 'nominal' END AS corroboration FROM summary, base)
"""


@query(MONTHLY + "SELECT lake_id, category, date, round(ndci_mean, 6) AS ndci_mean, water_px, n_scenes FROM monthly")
def monthly_ndci(t: Tables) -> DataFrame:
    """A10, P13, F15, F16"""
    return satellite.monthly_ndci(t["v_pixels"]).withColumn("ndci_mean", F.round("ndci_mean", 6))


@query(MONTHLY + "SELECT lake_id, category, date, round(ndci_mean, 6) AS ndci_mean, water_px, n_scenes FROM monthly")
def kept_monthly_ndci(t: Tables) -> DataFrame:
    """Kept by month; the last months' scenes come after the others, twice, and those of one lake last"""
    path, px = new_path(t.spark, "months"), t["v_pixels"]
    kind = F.when(F.col("lake_id") == 7, 2).when(F.col("sensed_date") >= F.lit("1998-09-01").cast("date"), 1).otherwise(0)
    for k in (0, 1, 1, 2):
        satellite.refresh_months(px.where(kind <= k), px.where(kind == k), path)
    return satellite.kept_months(t.spark, path).withColumn("ndci_mean", F.round("ndci_mean", 6))


@query(MONTHLY + "SELECT * FROM summary")
def lake_summary(t: Tables) -> DataFrame:
    """A8"""
    return satellite.lake_summary(satellite.monthly_ndci(t["v_pixels"]))


def _verdicts(t: Tables) -> DataFrame:
    return satellite.with_verdict(satellite.lake_summary(satellite.monthly_ndci(t["v_pixels"])))


@query(MONTHLY + "SELECT lake_id, round(clean_baseline, 6) AS clean_baseline, self_anomaly, exceeds_clean_baseline, vs_clean_ratio, corroboration FROM verdict")
def lake_verdicts(t: Tables) -> DataFrame:
    """A9, W17, F17, F20"""
    return _verdicts(t).select("lake_id", F.round("clean_baseline", 6).alias("clean_baseline"), "self_anomaly", "exceeds_clean_baseline", "vs_clean_ratio", "corroboration")


@query(MONTHLY + """SELECT lake_id, category, ndci_median, CASE WHEN exceeds_clean_baseline THEN 'yes' ELSE 'no' END AS exceeds,
 row_number() OVER (ORDER BY CASE category WHEN 'polluted' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, ndci_median DESC, lake_id) AS position FROM verdict""")
def lake_table(t: Tables) -> DataFrame:
    """W18"""
    summary = satellite.lake_summary(satellite.monthly_ndci(t["v_pixels"]))
    return satellite.lake_table(summary).select("lake_id", "category", "ndci_median", "exceeds", "position")


def _lakes(t: Tables) -> DataFrame:
    """Tracked lakes: suppliers under names that match some bodies' names exactly, some only when normalised."""
    s = t["supplier"]
    return s.select(F.col("s_suppkey").alias("lake_id"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.upper("s_name"), F.lit(" Reservoir"))).otherwise(F.col("s_name")).alias("lake"), F.col("s_suppkey").alias("ord"))


_KEY = "trim(regexp_replace(replace(replace(lower(trim(coalesce({0}, ''))), 'reservoir', ''), 'lake', ''), '\\s+', ' ', 'g'))".format
MATCHED = f"""lk AS (SELECT s_suppkey AS lake_id, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) || ' Reservoir' ELSE s_name END AS lake FROM supplier),
matched AS (SELECT b.id, b.name, coalesce((SELECT min(lake_id) FROM lk WHERE lake = b.name), CASE WHEN b.name IS NOT NULL THEN (SELECT min(lake_id) FROM lk WHERE {_KEY('lake')} = {_KEY('b.name')}) END) AS lake_id FROM v_bodies b)"""


@query(f"WITH {ctes('v_bodies')}, {MATCHED} SELECT id, lake_id FROM matched")
def matched_lakes(t: Tables) -> DataFrame:
    """J4, F25"""
    return satellite.match_lake(t["v_bodies"], _lakes(t))


@query(MONTHLY + f", {ctes('v_bodies')}, {MATCHED} SELECT m.id, n_months IS NOT NULL AS available, CASE WHEN n_months IS NULL THEN 'unknown' ELSE 'water_detected' END AS water_surface_status, coalesce(n_months, 0) AS n_months,"
       " CASE WHEN n_months IS NULL THEN '''' || coalesce(m.name, '') || ''' is not tracked. Tracked lakes (' || (SELECT count(DISTINCT lake) FROM lk) || '): ' || (SELECT string_agg(DISTINCT lake, ', ' ORDER BY lake) FROM lk) END AS note FROM matched m LEFT JOIN summary USING (lake_id)")
def lake_availability(t: Tables) -> DataFrame:
    """F48"""
    lakes = _lakes(t)
    return satellite.availability(satellite.match_lake(t["v_bodies"], lakes), t["v_bodies"], _verdicts(t), lakes)


@query(MONTHLY + f", {ctes('v_bodies')}, {MATCHED} SELECT DISTINCT lake FROM lk WHERE lake IS NOT NULL")
def tracked_lakes(t: Tables) -> DataFrame:
    """the register itself"""
    return satellite.register(_lakes(t))


@query(MONTHLY + f""", {ctes('v_bodies', 'v_reports')}, {MATCHED},
pt AS (WITH {POINTS}),
tier AS (SELECT m.id, CASE WHEN v.lake_id IS NOT NULL THEN 'cached_lake' ELSE 'on_demand_point' END AS mode, v.lake_id IS NOT NULL OR pt.available AS available, CASE WHEN v.lake_id IS NULL THEN pt.live_ndci ELSE v.ndci_latest END AS ndci,
 CASE WHEN v.lake_id IS NOT NULL THEN v.corroboration WHEN NOT pt.available THEN 'unavailable' WHEN pt.live_ndci > base.clean_baseline THEN 'watch' ELSE 'nominal' END AS corroboration,
 CASE WHEN v.lake_id IS NOT NULL THEN v.exceeds_clean_baseline ELSE coalesce(pt.live_ndci > base.clean_baseline, false) END AS exceeds, m.id % 29 = 0 AS failed
 FROM matched m CROSS JOIN base LEFT JOIN verdict v USING (lake_id) LEFT JOIN pt ON pt.id = m.id)
SELECT r.report_id, t.mode, CASE WHEN t.id IS NULL THEN 'pending' WHEN t.failed THEN 'error' WHEN t.available THEN 'done' ELSE 'unavailable' END AS satellite_status, t.ndci AS satellite_ndci, t.corroboration,
 CASE WHEN t.id IS NULL THEN 'processing' WHEN t.failed OR NOT t.available THEN 'unavailable' WHEN t.exceeds THEN CASE WHEN t.corroboration = 'elevated' THEN 'elevated' ELSE 'watch' END ELSE 'nominal' END AS badge
FROM v_reports r LEFT JOIN tier t ON t.id = r.water_body_id""")
def enriched_reports(t: Tables) -> DataFrame:
    """J5, H1, F17, F19, F21; both tiers, and bodies whose look-up failed"""
    points = spatial.point_metrics(t["v_bodies"], _located_pixels(t), f"{_POINT_END} 00:00:00")
    base = _verdicts(t).agg(F.max("clean_baseline").alias("base"))  # one value for all lakes
    points = points.crossJoin(base).select("id", "available", "live_ndci", (F.col("live_ndci") > F.col("base")).alias("exceeds_clean_baseline"))
    status = satellite.satellite_status(satellite.match_lake(t["v_bodies"], _lakes(t)), _verdicts(t), points)
    verdicts = status.select(F.col("id").alias("water_body_id"), "mode", "available", "live_ndci", F.col("ndci_latest").alias("latest_ndci"), "exceeds_clean_baseline", "corroboration", (F.col("id") % 29 == 0).alias("failed"))
    out = reports.enrich(t["v_reports"], verdicts)
    shown = R.badge(F.col("satellite_status"), F.lit(None).cast("string"), F.col("exceeds_clean_baseline"), F.col("corroboration"))
    return out.select("report_id", "mode", "satellite_status", "satellite_ndci", "corroboration", shown.alias("badge"))


_LOOKED_UP = """SELECT report_id, created_at + (report_id % 90) * INTERVAL 1 MINUTE AS checked_at, report_id % 11 = 0 AS failed, report_id % 7 <> 0 AS available, CASE WHEN report_id % 3 = 0 THEN algae_percentage / 100 END AS live_ndci,
 turbidity_score / 100 AS latest_ndci, algae_percentage > 50 AS exceeds, CASE WHEN report_id % 3 = 0 THEN 'high' END AS spatial_confidence, CASE WHEN algae_percentage > 50 THEN 'watch' ELSE 'nominal' END AS corroboration,
 CASE WHEN report_id % 3 = 0 THEN 'on_demand_point' ELSE 'cached_lake' END AS mode FROM {} WHERE report_id % 5 <> 0"""


@query(f"""WITH {ctes('v_reports')}, a AS ({_LOOKED_UP.format('v_reports')}),
j AS (SELECT r.report_id, a.*, a.report_id IS NULL OR a.failed AS lost FROM v_reports r LEFT JOIN a ON a.report_id = r.report_id AND a.checked_at <= r.created_at + INTERVAL 1 HOUR)
SELECT report_id, CASE WHEN lost THEN 'error' WHEN available THEN 'done' ELSE 'unavailable' END AS satellite_status, CASE WHEN NOT lost THEN coalesce(live_ndci, latest_ndci) END AS satellite_ndci, CASE WHEN NOT lost THEN exceeds END AS satellite_exceeds_clean_baseline,
 CASE WHEN NOT lost THEN corroboration END AS satellite_corroboration, CASE WHEN NOT lost THEN mode END AS satellite_mode, CASE WHEN NOT lost THEN checked_at END AS satellite_checked_at FROM j""")
def settled_reports(t: Tables) -> DataFrame:
    """H1: look-ups that answer in time, too late, never, or fail"""
    reports_ = t["v_reports"]
    out = enrichment.settle(reports_, t.spark.sql(_LOOKED_UP.format("{r}"), r=reports_))
    return out.select("report_id", "satellite_status", *[f"satellite_{c}" for c in ("ndci", "exceeds_clean_baseline", "corroboration", "mode", "checked_at")])


# evaluation


def _pairs(t: Tables) -> DataFrame:
    return t["v_probs"].select("doc_id", F.col("gt_binary").alias("y"), F.col("p_polluted").alias("p"), (F.col("p_polluted") >= 0.5).cast("int").alias("pred"), "gt3")


PAIRS = f"WITH {ctes('v_probs')}, q AS (SELECT doc_id, gt_binary AS y, p_polluted AS p, (p_polluted >= 0.5)::INT AS pred, gt3 FROM v_probs)"
_COUNTS = "count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn"
_RATES = """tp, fp, tn, fn, round((tp + tn) / greatest(1, tp + fp + tn + fn), 6) AS accuracy, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS sensitivity, round(tn / greatest(1, tn + fp), 6) AS specificity,
 round(CASE WHEN tp > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END, 6) AS f1"""


@query(PAIRS + f", c AS (SELECT {_COUNTS} FROM q) SELECT {_RATES} FROM c")
def binary_metrics(t: Tables) -> DataFrame:
    """A17, J9"""
    labels = t["v_probs"].select("doc_id", F.col("gt_binary").alias("y"))
    return evaluate.binary_metrics(evaluate.join_truth(_pairs(t).drop("y"), labels, "doc_id"))


_THREE = "m AS (SELECT gt3 AS y, CASE WHEN p < 0.3e0 THEN 0 WHEN p < 0.6e0 THEN 1 ELSE 2 END AS pred FROM q)"
_CLASSES = f"""{_THREE}, k AS (SELECT y AS class FROM m UNION SELECT pred FROM m),
pc AS (SELECT class, (SELECT count(*) FROM m WHERE y = class AND pred = class) AS hit, (SELECT count(*) FROM m WHERE y = class) AS support, (SELECT count(*) FROM m WHERE pred = class) AS said FROM k),
pr AS (SELECT class, hit, support, round(hit / greatest(1, said), 6) AS precision, round(hit / greatest(1, support), 6) AS recall, round(CASE WHEN hit > 0 THEN 2e0 * hit / (said + support) ELSE 0e0 END, 6) AS f1 FROM pc)"""


def _three(t: Tables) -> DataFrame:
    return _pairs(t).select(F.col("gt3").alias("y"), F.when(F.col("p") < 0.3, 0).when(F.col("p") < 0.6, 1).otherwise(2).alias("pred"))


@query(PAIRS + f", {_CLASSES} SELECT class, precision, recall, f1, support, hit FROM pr")
def per_class_metrics(t: Tables) -> DataFrame:
    """A18"""
    return evaluate.per_class_metrics(_three(t))


@query(PAIRS + f", {_CLASSES} SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM pr")
def multiclass_metrics(t: Tables) -> DataFrame:
    """A18"""
    return evaluate.multiclass_metrics(_three(t))


@query(PAIRS + f", {_THREE} SELECT y, pred, count(*) AS n FROM m GROUP BY 1, 2")
def confusion_matrix(t: Tables) -> DataFrame:
    """A18"""
    return evaluate.confusion(_three(t))


_GROUPED = "g AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM q GROUP BY 1)"
_CURVE = f"""{_GROUPED}, curve AS (SELECT p AS threshold, sum(neg) OVER w / (SELECT sum(neg) FROM g) AS fpr, sum(pos) OVER w / (SELECT sum(pos) FROM g) AS tpr FROM g WINDOW w AS (ORDER BY p DESC)
 UNION ALL SELECT 'infinity'::DOUBLE, 0, 0)"""


@query(PAIRS + f", {_GROUPED}, b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM b")
def roc_auc(t: Tables) -> DataFrame:
    """A19"""
    return evaluate.roc_auc(_pairs(t))


@query(PAIRS + f", {_CURVE} SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM curve")
def roc_curve(t: Tables) -> DataFrame:
    """A20"""
    return evaluate.roc_curve(_pairs(t)).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(PAIRS + f", {_CURVE} SELECT CASE WHEN threshold > 1 THEN 1e0 ELSE threshold END AS tau, round(tpr - fpr, 6) AS j FROM curve ORDER BY round(tpr - fpr, 9) DESC, threshold DESC LIMIT 1")
def youden_threshold(t: Tables) -> DataFrame:
    """A21"""
    return evaluate.youden(_pairs(t))


_FOLDS = "f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INT) AS fold FROM q)"


@query(PAIRS + f", {_FOLDS} SELECT doc_id, fold FROM f")
def stratified_folds(t: Tables) -> DataFrame:
    """W16"""
    return evaluate.stratified_folds(_pairs(t), "doc_id").select("doc_id", "fold")


_CV = f"""{_FOLDS}, tr AS (SELECT f.*, k AS test_fold FROM f, range(5) r(k) WHERE fold <> k), tg AS (SELECT test_fold, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM tr GROUP BY 1, 2),
tc AS (SELECT test_fold, p, sum(pos) OVER w / sum(pos) OVER a - sum(neg) OVER w / sum(neg) OVER a AS j FROM tg WINDOW w AS (PARTITION BY test_fold ORDER BY p DESC), a AS (PARTITION BY test_fold)),
tau AS (SELECT test_fold AS fold, p AS tau, row_number() OVER (PARTITION BY test_fold ORDER BY round(j, 9) DESC, p DESC) AS k FROM tc),
te AS (SELECT fold, tau, y, (p >= tau)::INT AS pred FROM f JOIN tau USING (fold) WHERE k = 1), fm AS (SELECT fold, tau, {_COUNTS} FROM te GROUP BY 1, 2), folds AS (SELECT fold, tau, {_RATES} FROM fm)"""


@query(PAIRS + f", {_CV} SELECT * FROM folds")
def cross_validated_calibration(t: Tables) -> DataFrame:
    """A22"""
    return evaluate.cv_calibrate(evaluate.stratified_folds(_pairs(t), "doc_id"))


@query(PAIRS + f", {_CV} SELECT " + ", ".join(f"round(avg({c}), 5) AS mean_{c}, round(stddev_pop({c}), 5) AS std_{c}" for c in ("accuracy", "sensitivity", "specificity", "f1")) + ", round(sum(tp + tn) / sum(tp + tn + fp + fn), 5) AS pooled_accuracy FROM folds")
def calibration_summary(t: Tables) -> DataFrame:
    """A22"""
    return evaluate.cv_summary(evaluate.cv_calibrate(evaluate.stratified_folds(_pairs(t), "doc_id")))


@query(PAIRS + f""", {_CV}, s AS (SELECT round(sum(tp + tn) / sum(tp + tn + fp + fn), 5) AS a FROM folds), g AS (SELECT (0.9988e0 - a) * 100 AS gap FROM s)
SELECT round(gap, 3) AS gap_pp, CASE WHEN gap > 15 THEN 'SIGNIFICANT' WHEN gap > 5 THEN 'MODERATE' ELSE 'MINIMAL' END AS verdict FROM g""")
def out_of_distribution_gap(t: Tables) -> DataFrame:
    """F35"""
    return evaluate.ood_gap(calibration_summary(t), 0.9988)


def _kappa(cats: list[int], col: str) -> str:
    counts = ", ".join("+".join(f"({col.format(f'annotator_{k}')} = {c})::INT" for k in (1, 2, 3)) + f" AS c{i}" for i, c in enumerate(cats))
    return f"""WITH {ctes('v_votes')}, v AS (SELECT {counts} FROM v_votes WHERE annotator_1 IS NOT NULL AND annotator_2 IS NOT NULL AND annotator_3 IS NOT NULL),
s AS (SELECT count(*) AS items, avg(({'+'.join(f'c{i} * c{i}' for i in range(len(cats)))} - 3) / 6e0) AS p, {'+'.join(f'pow(avg(c{i}) / 3, 2)' for i in range(len(cats)))} AS e FROM v)
SELECT items, round((p - e) / (1 - e), 6) AS kappa FROM s"""


_ANNOTATORS = ["annotator_1", "annotator_2", "annotator_3"]


@query(_kappa([0, 1, 2], "{}"))
def fleiss_kappa(t: Tables) -> DataFrame:
    """A23"""
    return evaluate.fleiss_kappa(t["v_votes"], _ANNOTATORS, [0, 1, 2])


@query(_kappa([0, 1], "least(1, {})"))
def fleiss_kappa_binary(t: Tables) -> DataFrame:
    """A23"""
    return evaluate.fleiss_kappa(t["v_votes"], _ANNOTATORS, [0, 1, 2], binary=True)


@query(PAIRS + ", r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS a, rank() OVER (ORDER BY gt3) + (count(*) OVER (PARTITION BY gt3) - 1) / 2e0 AS b FROM q) SELECT (SELECT round(corr(p, gt3), 6) FROM q) AS pearson, round(corr(a, b), 6) AS spearman FROM r")
def correlations(t: Tables) -> DataFrame:
    """A24, A25"""
    df = _pairs(t)
    return evaluate.pearson(df, "p", "gt3").crossJoin(evaluate.spearman(df, "p", "gt3"))  # one row each


@query(PAIRS + ", s AS (SELECT y, doc_id % 2 AS part, count(*) AS n FROM q GROUP BY 1, 2) SELECT part, y, n, round(sum(n) OVER (PARTITION BY part) / (2 * n), 6) AS weight, round(n / sum(n) OVER (PARTITION BY part), 6) AS share FROM s")
def class_weights(t: Tables) -> DataFrame:
    """A26"""
    return evaluate.class_weights(_pairs(t).withColumn("part", F.col("doc_id") % 2), "y", "part")


@query(PAIRS + ", n AS (SELECT gt3, count(*) AS n FROM q GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n) FILTER (WHERE gt3 > 0) / sum(n), 4) AS base_rate, round(max(n) / sum(n), 4) AS majority_share FROM n")
def label_statistics(t: Tables) -> DataFrame:
    """A6"""
    return reports.label_stats(_pairs(t), "gt3")


_MAJORITY = """CASE WHEN annotator_3 IS NULL THEN greatest(annotator_1, annotator_2) WHEN annotator_1 = annotator_2 OR annotator_1 = annotator_3 THEN annotator_1 WHEN annotator_2 = annotator_3 THEN annotator_2 ELSE greatest(annotator_1, annotator_2, annotator_3) END"""


@query(f"WITH {ctes('v_votes')} SELECT doc_id, {_MAJORITY} AS label FROM v_votes")
def majority_votes(t: Tables) -> DataFrame:
    """F32, P8"""
    none = F.lit(None).cast("int")
    return t["v_votes"].select("doc_id", R.final_label(none, none, F.array(*_ANNOTATORS)).alias("label"))


#: Items of incomplete votes get names that aren't numbers, so that the naming pattern has something to find.
_NAMED = "CASE WHEN annotator_3 IS NULL THEN concat('img', doc_id) ELSE CAST(doc_id AS STRING) END"


@query(f"""WITH {ctes('v_votes')}, c AS (SELECT *, {_NAMED} AS item, {_MAJORITY} AS consensus, CASE WHEN annotator_1 = annotator_2 OR annotator_1 = annotator_3 THEN annotator_1 WHEN annotator_2 = annotator_3 THEN annotator_2 ELSE annotator_1 END AS mode FROM v_votes),
parts AS (SELECT 'all' AS part, 200 AS least, 300 AS most, * FROM c UNION ALL SELECT 'agreed', 1, 1000000000, * FROM c WHERE annotator_3 IS NOT NULL AND (annotator_1 = annotator_2 OR annotator_1 = annotator_3 OR annotator_2 = annotator_3)),
sums AS (SELECT part, min(least) AS least, min(most) AS most, count(*) AS rows, count(DISTINCT item) AS items, CAST(sum((annotator_1 IS NULL)::INT + (annotator_2 IS NULL)::INT + (annotator_3 IS NULL)::INT) AS BIGINT) AS empty_cells,
 count(*) FILTER (WHERE consensus = mode) AS consensus_is_mode, count(*) FILTER (WHERE regexp_matches(item, '^[0-9]+$')) AS well_named FROM parts GROUP BY part)
SELECT part, rows, items, empty_cells, consensus_is_mode, well_named, CASE WHEN rows BETWEEN least AND most AND empty_cells = 0 AND consensus_is_mode = rows THEN 'PASS' ELSE 'FAIL' END AS verdict FROM sums""")
def data_quality(t: Tables) -> DataFrame:
    """All votes, and those complete ones of which two agree"""
    votes = t["v_votes"].withColumn("item", F.expr(_NAMED))
    a, b, c = (F.col(x) for x in _ANNOTATORS)
    said = R.majority(F.array(*_ANNOTATORS))
    parts = {"all": evaluate.dq_report(votes, "item", _ANNOTATORS, said), "agreed": evaluate.dq_report(votes.where(c.isNotNull() & ((a == b) | (a == c) | (b == c))), "item", _ANNOTATORS, said, 1, 10**9)}
    one, two = (report.withColumn("part", F.lit(part)) for part, report in parts.items())
    return one.unionByName(two)


@query(f"""WITH got AS (SELECT 'kappa' AS name, kappa AS value FROM ({_kappa([0, 1, 2], '{}')}) x UNION ALL SELECT 'rows', (SELECT count(*)::DOUBLE FROM labels)),
claims(name, expected, tolerance) AS (VALUES ('kappa', 0.757e0, 0.01e0), ('rows', 399e0, 0e0), ('absent', 1e0, 1e0))
SELECT name, value, expected, CASE WHEN coalesce(abs(value - expected) <= tolerance, FALSE) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM claims LEFT JOIN got USING (name)""")
def checked_claims(t: Tables) -> DataFrame:
    """A30"""
    got = evaluate.fleiss_kappa(t["v_votes"], _ANNOTATORS, [0, 1, 2]).select(F.lit("kappa").alias("name"), F.col("kappa").alias("value"))
    got = got.unionByName(t["labels"].agg(F.count("*").cast("double").alias("value")).withColumn("name", F.lit("rows")))
    claims = t.spark.createDataFrame([("kappa", 0.757, 0.01), ("rows", 399.0, 0.0), ("absent", 1.0, 1.0)], "name string, expected double, tolerance double")
    return evaluate.check_claims(got, claims)


@query(PAIRS + ", o AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS a, row_number() OVER (ORDER BY p DESC, doc_id) AS b FROM q) SELECT 'low' AS \"end\", y, count(*) AS n FROM o WHERE a <= 10 GROUP BY 1, 2 UNION ALL SELECT 'high', y, count(*) FROM o WHERE b <= 10 GROUP BY 1, 2")
def extremes_by_probability(t: Tables) -> DataFrame:
    """Ten at each end are the report"""
    return evaluate.extremes(_pairs(t), "p", "doc_id").groupBy("end", "y").agg(F.count("*").alias("n"))


_MODELS = {"factors": "base_level <> 'low'", "classifier": "eff_prediction = 'bad'", "ensemble": "level <> 'low'"}


@query(SCORED + ", l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, (turbidity_score < 50)::INT AS y, ({c})::INT AS pred FROM scored" for m, c in _MODELS.items()) + f""" UNION ALL SELECT 'detector', (turbidity_score < 50)::INT, (yolo_prediction <> 'clean')::INT FROM scored WHERE yolo_prediction IS NOT NULL),
c AS (SELECT model, {_COUNTS} FROM l GROUP BY 1), m AS (SELECT model, {_RATES} FROM c), b AS (SELECT model, f1 FROM m WHERE model <> 'ensemble' ORDER BY f1 DESC, model DESC LIMIT 1), d AS (SELECT b.model, (m.f1 - b.f1) * 100 AS d FROM m, b WHERE m.model = 'ensemble')
SELECT model AS best_single, round(d, 4) AS delta_pp, CASE WHEN d > 2 THEN 'ensemble better' WHEN d < -2 THEN 'ensemble worse' ELSE 'about equal' END AS verdict FROM d""")
def ensemble_verdict(t: Tables) -> DataFrame:
    """F31, F36, P9"""
    s = _scored(t).withColumn("y", (F.col("turbidity_score") < 50).cast("int"))
    said = {"factors": R.binary_label(F.col("base.risk_level")), "classifier": R.binary_label(F.col("eff_prediction")), "detector": R.binary_label(F.col("yolo_prediction")), "ensemble": R.binary_label(F.col("risk_level"))}
    long = s.select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in said.items()])).alias("x")).select("y", "x.*")
    kept, _ = evaluate.with_coverage(long, "pred")
    return evaluate.ensemble_report(evaluate.binary_metrics(kept, "model"), "ensemble")


@query(SCORED + """, p AS (SELECT avg((level = 'high')::INT) * 100 AS h, avg((level = 'low')::INT) * 100 AS l, avg((eff_prediction = 'bad')::INT) * 100 AS b FROM scored)
SELECT CASE WHEN h > 85 THEN 'over-predicts high' WHEN l > 85 THEN 'under-predicts' WHEN b > 90 THEN 'over-confident bad' ELSE '' END AS flags FROM p""")
def sanity_flags(t: Tables) -> DataFrame:
    """F37"""
    pct = lambda c: F.avg(c.cast("double")) * 100
    p = _scored(t).agg(pct(F.col("risk_level") == "high").alias("h"), pct(F.col("risk_level") == "low").alias("l"), pct(F.col("eff_prediction") == "bad").alias("b"))
    return p.select(F.array_join(R.sanity_flags(F.col("h"), F.col("l"), F.col("b")), ",").alias("flags"))


# fingerprints


def _hashed(t: Tables) -> DataFrame:
    return materialize(t["documents"].select("doc_id", "source", fingerprint.simhash_words(F.col("text")).alias("code")), "codes")


HASHED = """WITH RECURSIVE tk AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) x WHERE w <> ''),
hb AS (SELECT doc_id, h, b FROM (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 16)) AS UBIGINT) AS h FROM tk) y, range(64) r(b)),
bits AS (SELECT doc_id, b, sum(((h >> b::UBIGINT) & 1::UBIGINT)::INT) * 2 > count(*) AS one FROM hb GROUP BY 1, 2),
hs AS (SELECT d.doc_id, d.source, coalesce(CAST(sum(CASE WHEN one THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END) AS UBIGINT), 0::UBIGINT) AS code FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY 1, 2)"""


@query(HASHED + " SELECT doc_id, lpad(lower(printf('%x', code)), 16, '0') AS hash FROM hs")
def text_simhash(t: Tables) -> DataFrame:
    """F29, v_hash"""
    return _hashed(t).select("doc_id", R.code_hex(R.hex_code(R.code_hex(F.col("code")))).alias("hash"))


_PAIRS10 = "dc AS (SELECT DISTINCT code FROM hs), hp AS (SELECT a.code AS a, b.code AS b, bit_count(xor(a.code, b.code)) AS d FROM dc a JOIN dc b ON a.code < b.code WHERE bit_count(xor(a.code, b.code)) <= 10)"


@query(HASHED + f", {_PAIRS10} SELECT d, count(*) AS n FROM hp GROUP BY 1")
def hamming_pairs(t: Tables) -> DataFrame:
    """Links between different codes by distance"""
    return fingerprint.hamming_pairs(_hashed(t), "doc_id", "code").groupBy("d").agg(F.count("*").alias("n"))


_CLUSTERS = _PAIRS10 + """, ed AS (SELECT a, b FROM hp UNION ALL SELECT b, a FROM hp UNION ALL SELECT code, code FROM dc),
reach(a, b) AS (SELECT a, b FROM ed UNION SELECT r.a, e.b FROM reach r JOIN ed e ON r.b = e.a),
cl AS (SELECT hs.doc_id, hs.source, min(h2.doc_id) AS cluster_id FROM hs JOIN reach r ON r.a = hs.code JOIN hs h2 ON h2.code = r.b GROUP BY 1, 2)"""


def _clustered(t: Tables) -> DataFrame:
    return fingerprint.clusters(_hashed(t), "doc_id", "code")


@query(HASHED + f", {_CLUSTERS} SELECT doc_id, cluster_id FROM cl")
def similarity_clusters(t: Tables) -> DataFrame:
    """W15"""
    return _clustered(t).select("doc_id", "cluster_id")


@query(HASHED + f""", {_CLUSTERS}, z AS (SELECT cluster_id, count(*) AS n FROM cl GROUP BY 1), y AS (SELECT count(*) AS clusters, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest, round(avg(n), 6) AS mean, CAST(floor(quantile_cont(n, 0.5)) AS INT) AS median, round(stddev_pop(n), 6) AS std FROM z)
SELECT *, round(singletons * 100e0 / clusters, 4) AS singleton_pct, CASE WHEN singletons * 100e0 / clusters < 50 THEN 'HIGH' WHEN singletons * 100e0 / clusters > 90 THEN 'LOW' ELSE 'MODERATE' END AS risk FROM y""")
def cluster_statistics(t: Tables) -> DataFrame:
    """A15, F34"""
    return fingerprint.cluster_stats(_clustered(t))


_SPLIT = _CLUSTERS + """, sz AS (SELECT cluster_id, count(*) AS n, md5('42:' || cluster_id) AS draw FROM cl GROUP BY 1),
sp AS (SELECT cluster_id, CASE WHEN coalesce(sum(n) OVER (ORDER BY draw, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < floor((SELECT count(*) FROM cl) * 0.2e0) THEN 'val' ELSE 'train' END AS split FROM sz)"""


@query(HASHED + f", {_SPLIT} SELECT doc_id, split FROM cl JOIN sp USING (cluster_id)")
def group_split(t: Tables) -> DataFrame:
    """W14"""
    return fingerprint.group_split(_clustered(t)).select("doc_id", "split")


@query(HASHED + f", {_CLUSTERS}, rs AS (SELECT doc_id, cluster_id, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM cl), bo AS (SELECT cluster_id FROM rs GROUP BY 1 HAVING count(DISTINCT split) > 1) SELECT count(DISTINCT cluster_id) AS clusters, count(*) AS rows FROM rs WHERE cluster_id IN (SELECT cluster_id FROM bo)")
def split_overlap(t: Tables) -> DataFrame:
    """A random split's leaks"""
    return fingerprint.split_overlap(_clustered(t).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")))


_NEAREST = "nn AS (SELECT v.doc_id, min(bit_count(xor(v.code, h.code))) AS distance FROM hs v, hs h WHERE v.doc_id % 5 = 0 AND h.doc_id % 5 <> 0 GROUP BY 1)"


def _distances(t: Tables) -> DataFrame:
    h = _hashed(t)
    return fingerprint.nearest_code(h.where("doc_id % 5 = 0"), h.where("doc_id % 5 <> 0"))


@query(HASHED + f", {_NEAREST} SELECT doc_id, distance FROM nn")
def nearest_across_split(t: Tables) -> DataFrame:
    """J12"""
    return _distances(t).select("doc_id", "distance")


@query(HASHED + f", {_NEAREST} SELECT CAST(bin AS INT) AS bin, count(nn.doc_id) AS n FROM range(20) r(bin) LEFT JOIN nn ON nn.distance = bin GROUP BY 1")
def distance_histogram(t: Tables) -> DataFrame:
    """A16"""
    return fingerprint.distance_profile(_distances(t))


@query(HASHED + f""", {_NEAREST} SELECT min(distance) AS min, max(distance) AS max, round(avg(distance), 4) AS mean, quantile_cont(distance, 0.5) AS median, round(avg((distance < 5)::INT) * 100, 4) AS below_5, round(avg((distance < 10)::INT) * 100, 4) AS below_10,
 CASE WHEN avg((distance <= 6)::INT) * 100 > 10 THEN 'SEVERE' WHEN avg((distance <= 6)::INT) * 100 > 2 THEN 'MODERATE' WHEN avg((distance <= 6)::INT) > 0 THEN 'MINIMAL' ELSE 'NONE' END AS level FROM nn""")
def leakage_audit(t: Tables) -> DataFrame:
    """A16, F34"""
    return fingerprint.distance_summary(_distances(t))


@query(HASHED + f""", {_NEAREST},
lv AS (SELECT CASE WHEN avg((distance <= 6)::INT) * 100 > 10 THEN 'SEVERE' WHEN avg((distance <= 6)::INT) * 100 > 2 THEN 'MODERATE' WHEN avg((distance <= 6)::INT) > 0 THEN 'MINIMAL' ELSE 'NONE' END AS level FROM nn)
SELECT level AS leakage, round(accuracy, 6) AS accuracy, round((0.999e0 - accuracy) * 100, 4) AS drop_pp,
 CASE WHEN (0.999e0 - accuracy) * 100 < 2 THEN printf('Leakage %s; accuracy fell by %.1f points, less than 2: the reported accuracy holds.', level, (0.999e0 - accuracy) * 100)
 ELSE printf('Leakage %s; accuracy fell by %.1f points: report the group-aware accuracy.', level, (0.999e0 - accuracy) * 100) END AS conclusion
FROM lv, (SELECT avg((((d.n_chars % 1000) / 1000e0 >= 0.5)::INT = quality)::INT) AS accuracy FROM labels l JOIN documents d USING (doc_id)) a""")
def audit_summary(t: Tables) -> DataFrame:
    """A31, F47"""
    bench = _pairs(t).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
    return evaluate.audit_summary(fingerprint.distance_summary(_distances(t)).select("level"), bench, 0.999).withColumn("accuracy", F.round("accuracy", 6))


# curation


@query(f"WITH {ctes('v_curation')} SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY label, path) AS k FROM v_curation) x WHERE k = 1")
def exact_dedup(t: Tables) -> DataFrame:
    """W10, F28"""
    return curation.dedup_exact(t["v_curation"].select("doc_id", "label", "path", "hash"), "hash", "label", "path").select("doc_id", "label")


@query(f"WITH {ctes('v_curation')} SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY path) AS k FROM v_curation) x WHERE k <= 30")
def first_per_label(t: Tables) -> DataFrame:
    """The quota is the feature"""
    return curation.require_rows(curation.quota(t["v_curation"].select("doc_id", "label", "path"), "label", 30, "path"), 1).select("doc_id", "label")


@query(f"""WITH {ctes('v_curation')}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY path) AS k FROM v_curation), e AS (SELECT 205 // count(DISTINCT label) AS e FROM r),
o AS (SELECT doc_id, label, path, k <= e AS own, row_number() OVER (PARTITION BY k <= e ORDER BY path) AS j FROM r, e), n AS (SELECT 205 - count(*) AS missing FROM o WHERE own)
SELECT doc_id, 'image_' || lpad(row_number() OVER (ORDER BY path)::VARCHAR, 3, '0') AS item_id FROM o, n WHERE own OR j <= missing""")
def balanced_sample(t: Tables) -> DataFrame:
    """W12, W13"""
    rows = t["v_curation"].select("doc_id", "label", "path")
    return curation.number_rows(curation.balanced_sample(rows, 205, "label", "path"), "image_", 3, "path").select("doc_id", "item_id")


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')".format


@query(f"""WITH {ctes('v_curation')}, f AS (SELECT md5(text) AS hash, doc_id, label, path, doc_id % 9 <> 0 AS supported, NOT regexp_matches(concat_ws('_', {_SLUG('path')}, {_SLUG('text')}), '{"|".join(K.EXCLUDED_TERMS)}') AS relevant, length(text) > 100 AS valid FROM v_curation),
d AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY label, path) > 1 AS duplicate FROM f)
SELECT CASE WHEN NOT supported THEN 'unsupported' WHEN NOT relevant THEN 'irrelevant' WHEN NOT valid THEN 'invalid' WHEN duplicate THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM d GROUP BY 1""")
def skip_reasons(t: Tables) -> DataFrame:
    """A28, P11, P12, F26"""
    c = t["v_curation"]
    first = c.groupBy("hash").agg(F.min(F.struct("label", "path")).alias("first"))
    suffix = F.concat("path", F.when(F.col("doc_id") % 9 == 0, ".svg?x=1.jpg").otherwise(".JPG?width=9"))
    marked = c.join(first, "hash").withColumn("file", suffix)
    return curation.skip_counts(marked, curation.has_extension(F.col("file")), curation.is_relevant(F.col("path"), F.col("text")), F.length("text") > 100, F.struct("label", "path") != F.col("first"))


@query("""SELECT page_id, length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS n, substr(md5(url), 1, 4) AS h FROM pages""")
def stripped_pages(t: Tables) -> DataFrame:
    """F27"""
    return t["pages"].select("page_id", F.length(R.strip_tags(F.col("html"))).cast("bigint").alias("n"), F.substring(F.md5("url"), 1, 4).alias("h"))


_LICENSE = "CASE doc_id % 6 WHEN 0 THEN ' CC0 ' WHEN 1 THEN 'CC-BY-4.0' WHEN 2 THEN 'All rights reserved' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'Public Domain (US)' END"


@query(f"""WITH l AS (SELECT doc_id, {_LICENSE} AS license FROM documents) SELECT CASE WHEN coalesce(trim(license), '') = '' THEN 'missing' ELSE 'documented' END AS evidence_status, count(*) AS n,
 count(*) FILTER (WHERE regexp_matches(lower(trim(coalesce(license, ''))), '^(cc0|cc-by|pd|public domain)')) AS free FROM l GROUP BY 1""")
def license_evidence(t: Tables) -> DataFrame:
    """A32, F39, P10"""
    d = t["documents"].select(F.expr(_LICENSE).alias("license"))
    counts = evaluate.evidence_counts(d, "license")
    free = d.where(curation.free_license(F.col("license"))).groupBy(R.evidence_status(F.col("license")).alias("evidence_status")).agg(F.count("*").alias("free"))
    return counts.join(free, "evidence_status", "left").fillna({"free": 0})


@query("""SELECT n_nationkey AS key, 'nation' AS kind FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, 'region' FROM region""")
def union_and_difference(t: Tables) -> DataFrame:
    """U2, U3"""
    new = curation.absent(t["nation"].select(F.col("n_nationkey").alias("key")), t["region"].select(F.col("r_regionkey").alias("key")), "key")
    return curation.union_all(new.withColumn("kind", F.lit("nation")), t["region"].select(F.col("r_regionkey").alias("key"), F.lit("region").alias("kind")))


@query("""SELECT c.c_custkey, coalesce(r.r_name, '') AS place FROM customer c LEFT JOIN region r ON r.r_regionkey = c.c_nationkey""")
def enriched_metadata(t: Tables) -> DataFrame:
    """J10; four in five keys have no counterpart"""
    meta = t["region"].select(F.col("r_regionkey").alias("c_nationkey"), F.col("r_name").alias("place"))
    return evaluate.with_meta(t["customer"].select("c_custkey", "c_nationkey"), meta, "c_nationkey").select("c_custkey", "place")


# alerts

_PLACES = "SELECT id, lower(trim(city)) AS place FROM v_bodies UNION SELECT id, lower(trim(state)) FROM v_bodies"
MATCHED_AUTHORITY = f"""pl AS ({_PLACES}), ma AS (SELECT b.id, coalesce((SELECT min(a.ord) FROM pl JOIN v_authorities a ON lower(trim(a.jurisdiction)) = pl.place WHERE pl.id = b.id), (SELECT min(ord) FROM v_authorities WHERE is_default)) AS authority_ord FROM v_bodies b)"""


@query(f"WITH {ctes('v_bodies', 'v_authorities')}, {MATCHED_AUTHORITY} SELECT * FROM ma")
def matched_authority(t: Tables) -> DataFrame:
    """J8"""
    return alerts.match_authority(t["v_bodies"], t["v_authorities"])


@query(SCORED + f", {ctes('v_authorities')}, {MATCHED_AUTHORITY}" + """ SELECT sha256(report_id::VARCHAR) AS alert_id, report_id, s.water_body_id, authority_ord, level AS risk_level, score AS composite_score, 'pending_review' AS status,
 '[Water watch] ' || upper(level) || ' pollution risk: ' || coalesce(b.name, 'an unnamed water body') AS subject,
 concat_ws(chr(10), 'To: ' || a.name, 'Water body: ' || coalesce(b.name, 'an unnamed water body'), 'Location: ' || city || ', ' || state || printf(' (%.5f, %.5f)', s.latitude, s.longitude), printf('Risk: %s (%.1f/100)', upper(level), score),
  'Contamination: ' || contamination_type, 'Satellite: unavailable', 'Reported at: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S'), 'Report: ' || report_id, 'Screening by appearance only; please verify on site.') AS body, CAST(NULL AS VARCHAR) AS send_note
FROM scored s JOIN v_bodies b ON b.id = s.water_body_id JOIN ma ON ma.id = b.id JOIN v_authorities a ON a.ord = authority_ord WHERE level = 'high'""")
def alert_candidates(t: Tables) -> DataFrame:
    """H2, F22, F23, P7"""
    return alerts.candidates(_scored(t), t["v_bodies"], t["v_authorities"]).drop("created_at")


def _alerts(t: Tables) -> DataFrame:
    return alerts.candidates(_scored(t), t["v_bodies"], t["v_authorities"])


_ALERTS = SCORED + f""", {ctes('v_authorities')}, {MATCHED_AUTHORITY}, al AS (SELECT sha256(report_id::VARCHAR) AS alert_id, s.*, ma.authority_ord, a.name AS authority
 FROM scored s JOIN v_bodies b ON b.id = s.water_body_id JOIN ma ON ma.id = b.id LEFT JOIN v_authorities a ON a.ord = authority_ord WHERE level = 'high')"""


@query(_ALERTS + """ SELECT alert_id, report_id, status, created_at, count(*) OVER () AS total FROM (SELECT *, 'pending_review' AS status FROM al ORDER BY created_at DESC, alert_id LIMIT 200) x""")
def alert_list(t: Tables) -> DataFrame:
    """A page's limit is a feature; 500 are asked for and 200 are the most"""
    return alerts.list_alerts(_alerts(t), "pending_review", 500).select("alert_id", "report_id", "status", "created_at", "total")


_PAYLOAD = {"id": "alert_id", "report_id": "report_id::VARCHAR", "water_body_id": "water_body_id::VARCHAR", "authority_id": "authority_ord::VARCHAR", "recipient": "NULL::VARCHAR", "risk_level": "level",
 "composite_score": "printf('%.1f', score)", "status": "'pending_review'", "channel": "'email'", "created_at": "strftime(created_at, '%Y-%m-%dT%H:%M:%S')", "sent_at": "NULL::VARCHAR", "satellite_corroboration": "NULL::VARCHAR"}


@query(_ALERTS + " SELECT " + ", ".join(f"{v} AS {k}" for k, v in _PAYLOAD.items()) + " FROM al")
def alert_payloads(t: Tables) -> DataFrame:
    """The fields of each alert's JSON text, read back"""
    made = alerts.payload(_alerts(t), t["v_authorities"])
    return made.select(*[F.get_json_object("payload", f"$.{k}").alias(k) for k in _PAYLOAD])


@query(f"WITH {ctes('v_authorities')} SELECT ord, name, jurisdiction, is_default, count(*) OVER () AS total FROM v_authorities")
def authority_list(t: Tables) -> DataFrame:
    """P7"""
    return alerts.list_authorities(t["v_authorities"]).select("ord", "name", "jurisdiction", "is_default", "total")


@query(f"""WITH RECURSIVE {ctes('v_commands')}, f AS (
 SELECT DISTINCT alert_id, 0 AS seq, 'pending_review' AS status, CAST(NULL AS BIGINT) AS recipient, CAST(NULL AS VARCHAR) AS note, 0 AS errors FROM v_commands
 UNION ALL SELECT f.alert_id, c.seq,
  CASE WHEN c.command = 'dismiss' THEN 'dismissed' WHEN c.command = 'send' AND f.status = 'pending_review' AND f.recipient IS NOT NULL THEN 'sent' ELSE f.status END,
  CASE WHEN c.command = 'assign' THEN c.authority_id ELSE f.recipient END,
  CASE WHEN c.command = 'assign' THEN NULL WHEN c.command = 'dismiss' THEN coalesce(c.reason, 'Dismissed') WHEN f.status = 'pending_review' AND f.recipient IS NOT NULL THEN '{alerts.DRY_RUN}' ELSE f.note END,
  f.errors + (c.command = 'send' AND (f.status = 'dismissed' OR (f.status <> 'sent' AND f.recipient IS NULL)))::INT
 FROM f JOIN v_commands c ON c.alert_id = f.alert_id AND c.seq = f.seq + 1)
SELECT alert_id, status, recipient, note, errors FROM f WHERE seq = 3""")
def alert_state(t: Tables) -> DataFrame:
    """H3, J15"""
    return alerts.fold(t["v_commands"])


# photos and detections

_ROI = "SELECT image_id, r, g, b FROM v_photo_pixels WHERE x >= 1 AND x < 9 AND y >= 1 AND y < 9"
_HSV = f"""px AS ({_ROI}), mm AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo FROM px),
hh AS (SELECT *, CASE WHEN v = lo THEN 0e0 WHEN v = r THEN 60e0 * (g - b) / (v - lo) WHEN v = g THEN 120e0 + 60e0 * (b - r) / (v - lo) ELSE 240e0 + 60e0 * (r - g) / (v - lo) END AS h0 FROM mm),
hv AS (SELECT image_id, floor(CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END / 2 + 0.5)::BIGINT % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE floor(255e0 * (v - lo) / v + 0.5) END AS s, v FROM hh)"""


@query(f"WITH {ctes('v_photo_pixels')}, {_HSV}" + """ SELECT image_id, round(avg((h BETWEEN 35 AND 85 AND s >= 50 AND v >= 50)::INT) * 100, 4) AS green_pct, round(avg((s <= 30 AND v >= 200)::INT) * 100, 4) AS foam_pct,
 round(avg(((h BETWEEN 125 AND 165 AND s >= 50 AND v >= 50) OR (h BETWEEN 0 AND 10 AND s >= 100 AND v >= 100))::INT) * 100, 4) AS unnatural_pct, round(avg(v), 4) AS v_mean, round(stddev_pop(v), 4) AS v_std, round(stddev_pop(s), 4) AS s_std,
 round(CASE WHEN count(*) FILTER (WHERE s > 40) > 100 THEN stddev_pop(h) FILTER (WHERE s > 40) ELSE 0e0 END, 4) AS hue_std FROM hv GROUP BY 1""")
def colour_measures(t: Tables) -> DataFrame:
    """A33, P14, F43"""
    return photo.colour_measures(t["v_photo_pixels"])


@query(f"WITH {ctes('v_photo_pixels')}, bins AS (SELECT image_id, r // 16 AS br, g // 16 AS bg, b // 16 AS bb, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM ({_ROI}) x GROUP BY 1, 2, 3, 4), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, br, bg, bb) AS k FROM bins),"
       f" pal(i, pr, pg, pb) AS (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(K.FU_RGB, 1))}) SELECT image_id, n, round(r, 4) AS r, round(g, 4) AS g, round(b, 4) AS b, (SELECT arg_min(i, (pow(o.r - pr, 2) + pow(o.g - pg, 2) + pow(o.b - pb, 2), i)) FROM pal) AS fu_index FROM o WHERE k = 1")
def dominant_colours(t: Tables) -> DataFrame:
    """A34, J13"""
    return photo.dominant_rgb(t["v_photo_pixels"])


def _clusters_sql(steps: int) -> str:
    """Clusters step by step: seeds, then centres (k, cr, cg, cb) moved ``steps`` times."""
    away = "pow({0}.r - {1}.cr, 2) + pow({0}.g - {1}.cg, 2) + pow({0}.b - {1}.cb, 2)".format
    seed = lambda k, order, source: f"s{k} AS MATERIALIZED (SELECT image_id, {k} AS k, r AS cr, g AS cg, b AS cb FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}, r, g, b) AS o FROM {source}) y WHERE o = 1)"
    far = lambda *of: "(SELECT h.*, least(" + ", ".join(away("h", f"s{k}") for k in of) + ") AS d FROM h " + " ".join(f"JOIN s{k} ON s{k}.image_id = h.image_id" for k in of) + ") x"
    parts = [
        f"h AS MATERIALIZED (SELECT image_id, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, count(*) AS n FROM ({_ROI}) x GROUP BY 1, 2, 3, 4)",
        seed(0, "n DESC", "h"), seed(1, "d DESC", far(0)), seed(2, "d DESC", far(0, 1)), "c0 AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)",
    ]
    for i in range(steps + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT h.image_id, r, g, b, n, arg_min(k, ({away('h', f'c{i}')}, k)) AS k FROM h JOIN c{i} ON c{i}.image_id = h.image_id GROUP BY ALL)")
        moved = ", ".join(f"coalesce(m.{x}, c{i}.c{x}) AS c{x}" for x in "rgb")
        sums = f"(SELECT image_id, k, {', '.join(f'sum(n * {x}) / sum(n) AS {x}' for x in 'rgb')} FROM a{i} GROUP BY 1, 2)"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.image_id, c{i}.k, {moved} FROM c{i} LEFT JOIN {sums} m ON m.image_id = c{i}.image_id AND m.k = c{i}.k)")
    parts.append(f"big AS (SELECT image_id, k, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, k) AS o FROM (SELECT image_id, k, sum(n)::BIGINT AS n FROM a{steps} GROUP BY 1, 2) x)")
    parts.append(f"o AS (SELECT image_id, n, trunc(cr)::INT AS r, trunc(cg)::INT AS g, trunc(cb)::INT AS b FROM big JOIN c{steps} USING (image_id, k) WHERE o = 1)")
    return ",\n".join(parts)


@query(f"WITH {ctes('v_photo_pixels')}, {_clusters_sql(photo.STEPS)}, pal(i, pr, pg, pb) AS (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(K.FU_RGB, 1))})"
       " SELECT image_id, n, r, g, b, (SELECT arg_min(i, (pow(o.r - pr, 2) + pow(o.g - pg, 2) + pow(o.b - pb, 2), i)) FROM pal) AS fu_index FROM o")
def dominant_clusters(t: Tables) -> DataFrame:
    """The largest of three clusters of each image's colours"""
    return photo.dominant_cluster(t["v_photo_pixels"])


@query(f"""WITH {ctes('v_detections')}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, turn) AS k FROM v_detections)
SELECT conv_id, count(*)::INT AS n, max(class) FILTER (WHERE k = 1) AS top_class, max(confidence) AS top_confidence, coalesce(max(confidence) FILTER (WHERE class IN ('polluted', 'algae')), 0e0) AS pollution_confidence,
 printf('%d detections, top %s %.0f%%', count(*), max(class) FILTER (WHERE k = 1), round(max(confidence) * 100)) AS summary, count(*) FILTER (WHERE class = 'clean') AS clean, count(*) FILTER (WHERE class = 'polluted') AS polluted, count(*) FILTER (WHERE class = 'turbid') AS turbid FROM o GROUP BY 1""")
def detections(t: Tables) -> DataFrame:
    """A7, F40-F42"""
    out = photo.detections(t["v_detections"])
    counts = [F.coalesce(F.try_element_at("class_counts", F.lit(c)), F.lit(0)).alias(c) for c in ("clean", "polluted", "turbid")]
    return out.select("conv_id", "n", "top_class", "top_confidence", "pollution_confidence", "summary", *counts)


# streams, as batches; the tests run them as streams


@query(f"""WITH {ctes('v_reports')}, w AS (SELECT water_body_id, time_bucket(INTERVAL 1 DAY, created_at) - to_days(k::INT) AS window_start FROM v_reports, range(7) r(k))
SELECT water_body_id, window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS n FROM w GROUP BY 1, 2""")
def rolling_counts(t: Tables) -> DataFrame:
    """H5"""
    return streams.rolling_counts(t["v_reports"])


@query(SCORED + """, w AS (SELECT *, time_bucket(INTERVAL 7 DAY, created_at, TIMESTAMP '1970-01-01 00:00:00') AS window_start FROM scored)
SELECT water_body_id, window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS report_count, round(avg(score) + 1e-9, 4) AS risk_score, round(avg(algae_percentage) + 1e-9, 4) AS avg_algae_pct, round(avg(foam_coverage_pct) + 1e-9, 4) AS avg_foam_coverage, round(avg(turbidity_score) + 1e-9, 4) AS avg_turbidity FROM w GROUP BY 1, 2""")
def weekly_snapshots(t: Tables) -> DataFrame:
    """H6"""
    return streams.weekly_snapshots(_scored(t))


# tables (S1-S11): written from the given tables in the shared folder, then read by the reader in question


@query(f"""WITH {ctes('v_bodies')}
SELECT CAST(id AS VARCHAR) AS id, name, 'lake' AS type, coalesce(city, 'Bengaluru') AS city, coalesce(state, 'Karnataka') AS state, 0e0 AS current_risk_score, 'low' AS current_risk_level, 0 AS total_reports FROM v_bodies
UNION ALL SELECT 'c' || c_custkey, c_name, coalesce(lower(c_mktsegment), 'lake'), 'Bengaluru', 'Karnataka', coalesce(c_acctbal, 0e0), 'low', 0 FROM customer""")
def evolved_bodies(t: Tables) -> DataFrame:
    """Files of one table that differ in their columns"""
    path = new_path(t.spark, "bodies")
    t["v_bodies"].select(F.col("id").cast("string"), "name", "latitude", "longitude", "city", "state").write.parquet(path)
    later = t["customer"].select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("type"), F.col("c_acctbal").alias("current_risk_score"))
    later.write.mode("append").parquet(path)
    return tables.read_table(t.spark, path, "water_bodies").select("id", "name", "type", "city", "state", "current_risk_score", "current_risk_level", "total_reports")


@query(f"""WITH {ctes('v_votes')} SELECT 'doc' || doc_id || '.jpg' AS image_id,
 CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN NULL ELSE {_MAJORITY} END AS label FROM v_votes""")
def votes_from_csv(t: Tables) -> DataFrame:
    """Names and labels found among a CSV's columns"""
    path = new_path(t.spark, "votes")
    consensus = F.expr("CASE doc_id % 6 WHEN 0 THEN '2' WHEN 1 THEN '1.0' WHEN 2 THEN 'EXCLUDE' WHEN 3 THEN '7' END")
    t["v_votes"].select(F.format_string("doc%d.jpg", "doc_id").alias("filename"), consensus.alias("consensus_label"), *_ANNOTATORS).write.csv(path, header=True)
    return tables.resolve_columns(tables.read_csv(t.spark, path)).select("image_id", "label")


@query("""SELECT 'Lake ' || o_custkey AS lake, CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown' ELSE o_orderpriority END AS category, strftime(o_orderdate, '%Y-%m') AS date,
 (o_orderkey % 200 - 100) / 100e0 AS ndci_mean, o_orderkey % 3000 AS water_px, CASE WHEN o_orderpriority NOT LIKE '2%' THEN o_orderkey % 9 END AS n_scenes
FROM orders WHERE o_orderstatus NOT IN ('F', 'P')""")
def monthly_series_csv(t: Tables) -> DataFrame:
    """A sorted CSV whose values are partly blank, 'None' or no numbers"""
    path = new_path(t.spark, "series")
    rows = t["orders"].selectExpr(
        "concat('Lake ', o_custkey) AS lake", "CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderpriority END AS category", "date_format(o_orderdate, 'yyyy-MM') AS date",
        "CASE o_orderstatus WHEN 'F' THEN 'None' WHEN 'P' THEN if(o_orderkey % 2 = 0, '', 'n/a') ELSE CAST((o_orderkey % 200 - 100) / 100e0 AS STRING) END AS ndci_mean",
        "o_orderkey % 3000 AS water_px", "CASE WHEN o_orderpriority LIKE '2%' THEN 'some' ELSE CAST(o_orderkey % 9 AS STRING) END AS n_scenes",
    )
    tables.write_sorted_csv(rows, path, "lake", "date")
    return tables.read_ndci_monthly(t.spark, path)


@query("SELECT 'source=' || source AS label, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def labelled_files(t: Tables) -> DataFrame:
    """Folders are labels; only text files count"""
    path = new_path(t.spark, "files")
    t["documents"].select("source", "text").write.partitionBy("source").text(path)
    return tables.read_labelled_files(t.spark, path, ("txt",)).groupBy("label").agg(F.sum("length").alias("bytes"))


@query(f"WITH {ctes('v_probs')} SELECT doc_id, p_polluted FROM v_probs")
def cached_probabilities(t: Tables) -> DataFrame:
    """Made once; what the second call would make is never asked for"""
    path = new_path(t.spark, "probabilities")
    made = t["v_probs"].select("doc_id", "p_polluted")
    tables.load_or_compute(t.spark, path, lambda: made)
    return tables.load_or_compute(t.spark, path, lambda: made.withColumn("p_polluted", -F.col("p_polluted")))


@query(f"WITH {ctes('v_curation')} SELECT doc_id, label, hash FROM v_curation")
def split_files(t: Tables) -> DataFrame:
    """A folder for each label"""
    path = new_path(t.spark, "split")
    tables.write_split(t["v_curation"].select("doc_id", "label", "hash"), path, "label", "doc_id")
    return t.spark.read.parquet(path).select("doc_id", "label", "hash")


@query(f"""WITH {ctes('v_probs')} SELECT count(*) AS rows, CAST(sum(gt_binary) AS BIGINT) AS positive, max(p_polluted) AS highest, 'ok' AS status FROM v_probs
UNION ALL SELECT NULL, NULL, NULL, 'NOT RUN'""")
def stored_report(t: Tables) -> DataFrame:
    """A report read back, and one that was never written"""
    path, ddl = new_path(t.spark, "report"), "labels struct<rows:bigint,positive:bigint>, highest double"
    tables.write_report(t["v_probs"].agg(F.struct(F.count("*").alias("rows"), F.sum("gt_binary").alias("positive")).alias("labels"), F.max("p_polluted").alias("highest")), path)
    both = tables.read_report(t.spark, path, ddl).unionByName(tables.read_report(t.spark, f"{path}-absent", ddl))
    return both.select("labels.rows", "labels.positive", "highest", "status")


@query("SELECT c_name AS name, CASE WHEN c_nationkey < 10 THEN 'seed' ELSE 'new' END AS origin FROM customer")
def appended_rows(t: Tables) -> DataFrame:
    """All customers come, of whom some are there already; then all once more"""
    path, name = new_path(t.spark, "appended"), F.col("c_name").alias("name")
    tables.append_new(t["customer"].where("c_nationkey < 10").select(name, F.lit("seed").alias("origin")), path, "name")
    tables.append_new(t["customer"].select(name, F.lit("new").alias("origin")), path, "name", "all")
    tables.append_new(t["customer"].select(name, F.lit("again").alias("origin")), path, "name", "all again")
    return tables.appended(t.spark, path, "name")


# look-ups and payloads


@query(SCORED + "SELECT report_id, water_body_id, score AS composite_score, level AS risk_level FROM scored WHERE report_id = 42")
def report_by_id(t: Tables) -> DataFrame:
    """One key is the feature"""
    return reports.get_by_id(_scored(t), "report_id", 42).select("report_id", "water_body_id", "composite_score", "risk_level")


@query(SCORED + """SELECT report_id, water_body_id, contamination_type, score AS composite_score, level AS risk_level, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
 CASE WHEN foam_coverage_pct > 20 THEN 'live' ELSE 'pending' END AS status, CASE WHEN foam_coverage_pct > 20 THEN oil_coverage_pct / 10e0 END AS ndci,
 CASE WHEN foam_coverage_pct > 20 THEN oil_coverage_pct > 3 END AS exceeds_clean_baseline, strftime(CASE WHEN foam_coverage_pct > 20 THEN created_at + INTERVAL 1 HOUR END, '%Y-%m-%dT%H:%M:%S') AS checked_at FROM scored""")
def report_payloads(t: Tables) -> DataFrame:
    """P5: with the nested verdict"""
    seen = F.col("foam_coverage_pct") > 20
    checked = _scored(t).withColumns({
        "satellite_status": F.when(seen, "live").otherwise("pending"), "satellite_ndci": F.when(seen, F.col("oil_coverage_pct") / 10), "satellite_exceeds_clean_baseline": F.when(seen, F.col("oil_coverage_pct") > 3),
        "satellite_checked_at": F.when(seen, F.col("created_at") + F.expr("INTERVAL 1 HOUR")), **{f"satellite_{c}": F.lit(None).cast("string") for c in ("spatial_confidence", "corroboration", "mode")},
    })
    out = reports.report_payload(checked)
    return out.select("report_id", "water_body_id", "contamination_type", "composite_score", "risk_level", "created_at", *[F.col(f"satellite_verdict.{c}").alias(c) for c in ("status", "ndci", "exceeds_clean_baseline", "checked_at")])


@query("SELECT doc_id, quality AS label FROM labels WHERE toxic = 0")
def valid_labels(t: Tables) -> DataFrame:
    """Labels as text; those of toxic documents are no number or no label"""
    text = F.expr("CASE WHEN toxic = 1 THEN if(quality = 1, '3', 'x') WHEN quality = 1 THEN '1.0' ELSE '0' END")
    return curation.valid_labels(t["labels"].select("doc_id", text.alias("label")), "label")
