"""Views that give the driver's tables the shape of reports, water bodies, pixels and so on (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: All times are relative to this one.
AS_OF = "2024-01-31 00:00:00"

_REPORTS = """
SELECT event_id AS report_id, user_id AS water_body_id, ts AS created_at,
 12.9e0 + (user_id % 40) * 0.01e0 + ((event_id % 41) - 20) * 0.0002e0 AS latitude,
 77.5e0 + (user_id % 37) * 0.01e0 + ((event_id % 31) - 15) * 0.0002e0 AS longitude,
 CASE event_id % 10 WHEN 0 THEN 'industrial_discharge' WHEN 1 THEN 'sewage' WHEN 2 THEN 'algal_bloom' WHEN 3 THEN 'solid_waste'
  WHEN 4 THEN 'agricultural_runoff' WHEN 5 THEN 'fish_kill' WHEN 6 THEN 'foam' WHEN 7 THEN 'oil_spill' WHEN 8 THEN 'others' ELSE event_type END AS contamination_type,
 value AS algae_percentage,
 CAST((k * 7 + event_id) % 45 AS DOUBLE) AS foam_coverage_pct,
 CAST(100 - k AS DOUBLE) AS turbidity_score,
 CAST(1 + event_id % 21 AS INT) AS forel_ule_index,
 CAST((k * 3) % 11 AS DOUBLE) AS oil_coverage_pct,
 CAST((k * 13) % 101 AS DOUBLE) AS color_abnormality_score,
 CAST((event_id * 7) % 53 AS DOUBLE) AS debris_density,
 CASE WHEN k % 2 = 0 THEN 'bad' ELSE 'good' END AS eff_prediction,
 0.5e0 + (event_id % 50) * 0.01e0 AS eff_confidence,
 CASE event_id % 4 WHEN 0 THEN 'polluted' WHEN 1 THEN 'turbid' WHEN 2 THEN 'clean' END AS yolo_prediction,
 0.5e0 + (k % 50) * 0.01e0 AS yolo_confidence
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e"""

_BODIES = """
SELECT u.user_id AS id, CASE WHEN u.user_id % 7 = 0 THEN 'Lake ' || s.s_name ELSE s.s_name END AS name,
 12.9e0 + (u.user_id % 40) * 0.01e0 AS latitude, 77.5e0 + (u.user_id % 37) * 0.01e0 AS longitude,
 n.n_name AS city, r.r_name AS state
FROM (SELECT DISTINCT user_id FROM {events}) u
JOIN {nation} n ON n.n_nationkey = u.user_id % 25 JOIN {region} r ON r.r_regionkey = n.n_regionkey
LEFT JOIN {supplier} s ON s.s_suppkey = u.user_id"""

_PIXELS = """
SELECT l_suppkey AS lake_id, l_partkey % 50 AS pixel_id, l_orderkey AS scene_id, l_shipdate AS sensed_date,
 CAST((l_orderkey * 31) % 100 AS DOUBLE) AS cloudy_pct,
 l_quantity AS b3, 10 + l_tax * 100 AS b4, 10 + l_discount * 150 AS b5, 25 + l_tax * 100 AS b8,
 CAST(l_orderkey % 12 AS INT) AS scl,
 CASE l_suppkey % 3 WHEN 0 THEN 'polluted' WHEN 1 THEN 'moderate' ELSE 'clean_reference' END AS category
FROM {lineitem}"""

_PROBS = """
SELECT l.doc_id, l.quality AS gt_binary, l.quality + l.toxic AS gt3, (d.n_chars % 1000) / 1000.0e0 AS p_polluted
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id"""

_VOTES = """
SELECT doc_id, quality + toxic AS annotator_1,
 CASE WHEN doc_id % 7 = 0 THEN (quality + toxic + 1) % 3 ELSE quality + toxic END AS annotator_2,
 CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN (quality + toxic + 2) % 3 ELSE quality + toxic END AS annotator_3
FROM {labels}"""

_DETECTIONS = """
SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'turbid' ELSE 'polluted' END AS class,
 (length(text) % 100) / 100.0e0 AS confidence FROM {conversations}"""

_AUTHORITIES = """
SELECT 0 AS ord, 'Default board' AS name, CAST(NULL AS VARCHAR(50)) AS jurisdiction, TRUE AS is_default
UNION ALL SELECT 1 + r_regionkey, 'Board ' || r_name, lower(r_name), FALSE FROM {region} WHERE r_regionkey < 3
UNION ALL SELECT 10 + n_nationkey, 'Board ' || n_name, ' ' || n_name, FALSE FROM {nation} WHERE n_nationkey % 2 = 0"""

_CURATION = """
SELECT doc_id, source AS label, source || '/' || CAST(doc_id AS VARCHAR(20)) AS path, md5(text) AS hash, text FROM {documents}"""

_PHOTO_PIXELS = """
SELECT p_partkey AS image_id, i % 10 AS x, CAST(floor(i / 10e0) AS BIGINT) AS y, 10 AS width, 10 AS height, (p_partkey * 7 + i * 13) % 256 AS r,
 (p_partkey * 11 + i * 29) % 256 AS g, (p_partkey * 17 + i * 5) % 256 AS b FROM {part} CROSS JOIN {R}"""

_COMMANDS = """
SELECT r.report_id AS alert_id, s.seq, CASE (r.report_id + s.seq * (1 + r.report_id % 2)) % 3 WHEN 0 THEN 'assign' WHEN 1 THEN 'send' ELSE 'dismiss' END AS command,
 CASE WHEN (r.report_id + s.seq * (1 + r.report_id % 2)) % 3 = 0 THEN 10 + r.report_id % 25 END AS authority_id,
 CASE WHEN r.report_id % 4 = 0 THEN 'duplicate report' END AS reason
FROM {v_reports} r CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2 UNION ALL SELECT 3) s WHERE r.turbidity_score < 30"""

VIEWS = {
    "v_reports": _REPORTS, "v_bodies": _BODIES, "v_pixels": _PIXELS, "v_probs": _PROBS, "v_votes": _VOTES, "v_detections": _DETECTIONS,
    "v_authorities": _AUTHORITIES, "v_curation": _CURATION, "v_photo_pixels": _PHOTO_PIXELS, "v_commands": _COMMANDS,
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The tables of a folder, and the views over them, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name]
        used = {t: self[t] for t in (*TABLES, *VIEWS) if "{" + t + "}" in text}
        if "{R}" in text:
            used["R"] = self.spark.range(100).withColumnRenamed("id", "i")
        return self.spark.sql(text.replace("{R}", "{R} t"), **used)


def ctes(*names: str) -> str:
    """``name AS (...)`` clauses of views for DuckDB, and of the views that they stand on."""
    out: dict[str, str] = {}
    for name in names:
        text = VIEWS[name]
        for other in VIEWS:
            if "{" + other + "}" in text:
                out[other] = ""
        out[name] = ""
    plain = {t: t for t in (*TABLES, *VIEWS)} | {"R": "(SELECT range AS i FROM range(100)) t"}
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in out)
