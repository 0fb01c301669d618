"""Operators against loops on small tables."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import fixed as K
from tarnlight.operators import alerts, curation, evaluate, fingerprint, founders, photo, reports, satellite, spatial
from tarnlight.operators.graph import connected_components
from tarnlight.streaming import alert_states


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(x)))


@pytest.mark.parametrize(("lat", "lon"), [(12.9, 77.5), (-0.001, 0.001), (51.0, 179.999), (78.0, -20.0)])
def test_nearest_within_matches_a_loop(spark, lat, lon):
    rng = random.Random(lat)
    wrap = lambda x: (x + 180) % 360 - 180
    spot = lambda: (lat + rng.uniform(-0.02, 0.02), wrap(lon + rng.uniform(-0.02, 0.02) / math.cos(math.radians(lat))))
    bodies, points = [(i, *spot()) for i in range(60)], [(i, *spot()) for i in range(150)]
    want = {}
    for i, *p in points:
        near = min((metres(p, b), k) for k, *b in bodies)
        if near[0] <= 500:
            want[i] = near[1]
    got = spatial.nearest_within(spark.createDataFrame(points, "report_id long, latitude double, longitude double"), spark.createDataFrame(bodies, "id long, latitude double, longitude double"))
    assert {r.report_id: r.body_id for r in got.collect()} == want


def test_resolve_bodies_follows_the_order_of_reports(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(i, 12.9 + rng.choice([0, 0.003, 0.006, 0.009]) + rng.uniform(0, 0.001), 77.5 + rng.uniform(0, 0.002), start + timedelta(minutes=rng.randrange(50))) for i in range(60)]
    rows += [(100 + i, *rows[i][1:3], start + timedelta(days=1)) for i in range(5)]
    bodies = [(1, "Known", 12.9, 77.5)]
    known, made, want = [(b[0], b[2:4]) for b in bodies], [], {}
    missed = []
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        near = min((metres(r[1:3], p), i) for i, p in known)
        if near[0] <= 500:
            want[r[0]] = str(near[1])
        else:
            missed.append(r)
    for r in missed:
        near = min(((metres(r[1:3], p), i) for i, p in made), default=(1e9, 0))
        if near[0] > 500:
            made.append((r[0], r[1:3]))
            near = (0, r[0])
        want[r[0]] = f"new-{near[1]}"
    got = spatial.resolve_bodies(spark.createDataFrame(rows, "report_id long, latitude double, longitude double, created_at timestamp"), spark.createDataFrame(bodies, "id long, name string, latitude double, longitude double"))
    assert {r.report_id: r.body_id for r in got.collect()} == want


def test_resolve_bodies_keeps_each_row_once(spark):
    """Repeated ids, repeated places, places that are null or not on earth."""
    at = datetime(2024, 1, 1)
    rows = [(1, 10.0, 20.0, at), (1, 10.0, 20.0, at), (2, 10.0, 20.0, at), (3, None, 20.0, at), (4, 10.001, 20.0, None), (5, float("nan"), 20.0, at), (6, 95.0, 20.0, at), (None, 50.0, 20.0, at), (1, 10.0, 20.001, at), (7, -0.0, 180.0, at), (8, 0.0, -179.9999, at)]
    bodies = spark.createDataFrame([], "id long, name string, latitude double, longitude double")
    got = spatial.resolve_bodies(spark.createDataFrame(rows, "report_id long, latitude double, longitude double, created_at timestamp"), bodies)
    pairs = sorted(((r.report_id, r.body_id) for r in got.collect()), key=str)
    assert pairs == sorted([(1, "new-4"), (1, "new-4"), (1, "new-4"), (2, "new-4"), (3, None), (4, "new-4"), (5, None), (6, None), (None, None), (7, "new-7"), (8, "new-7")], key=str)


def _in_turn(places):
    made = []
    for p in places:
        if all(metres(p, q) > 500 for q in made):
            made.append(p)
    return set(made)


def _founders(spark, places, tile, made=()):
    schema = "latitude double, longitude double, at struct<age:int,n:int>"
    rows = [(float(y), float(x), (1, n)) for n, (y, x) in enumerate(places)]
    before = spark.createDataFrame([(float(y), float(x), (0, n)) for n, (y, x) in enumerate(made)], schema) if made else None
    found, rounds = founders.choose(spark.createDataFrame(rows, schema), before, tile=tile)
    return {(r.latitude, r.longitude) for r in found.where("at.age = 1").collect()}, rounds


def test_founders_of_a_chain_take_rounds_by_tiles_crossed(spark):
    chain = [(10.0 + 0.0036 * i, 20.0) for i in range(1000)]  # 400 m each: 400 km
    got, rounds = _founders(spark, chain, 60_000.0)
    assert got == _in_turn(chain) == set(chain[::2])
    assert 2 <= rounds <= 400 // 60 + 2


def test_founders_across_tiles_in_any_order(spark):
    rng = random.Random(8)
    for middle in ((0.0, 180.0), (60.0, 20.0)):
        places = [(middle[0] + rng.uniform(-0.03, 0.03), (middle[1] + rng.uniform(-0.03, 0.03) + 180) % 360 - 180) for _ in range(500)]
        assert _founders(spark, places, 1500.0)[0] == _in_turn(places)
        known = places[:40:9]
        assert _founders(spark, places[40:], 1500.0, known)[0] == _in_turn(list(known) + places[40:]) - set(known)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_hamming_bands_lose_no_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) & (2**64 - 1) for c in base for _ in range(6)}
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 10}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(signed)], "id long, code long")
    assert {(r.a, r.b) for r in fingerprint.hamming_pairs(df, "id", "code").collect()} == want
    assert len(want) > 20


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_hamming_pairs_in_blocks_are_exact(spark, block, monkeypatch):
    """Blocks of one to all codes, equal codes, null codes, the ends of the range; nothing is broadcast, however small it looks."""
    monkeypatch.setattr(fingerprint, "FAR_BLOCK", block)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    codes = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in base for _ in range(9)] + base + [0, 1, 2**63, 2**64 - 1]
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*signed, None, None])], "id long, code long")
    got = fingerprint.hamming_pairs(df, "id", "code")
    rows = [tuple(r) for r in got.select("a", "b", "d").collect()]
    mask = (1 << 64) - 1
    assert sorted(rows) == sorted((a, b, d) for a in set(signed) for b in set(signed) if a < b and (d := ((a ^ b) & mask).bit_count()) <= 10)
    assert fingerprint.hamming_pairs(df.limit(0), "id", "code").count() == 0


def test_searches_by_code_broadcast_nothing(spark, tmp_path, monkeypatch):
    """Sizes are estimated from before codes are repeated for their flipped bits, so a broadcast would bring all of that to the driver."""
    spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("code")).write.parquet(f"{tmp_path}/codes")
    df = spark.read.parquet(f"{tmp_path}/codes")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert all("Broadcast" not in plan(x) for x in (fingerprint.hamming_pairs(df, "doc_id", "code"), fingerprint.near_codes(df, df, 10, 4)))
    seen = []
    monkeypatch.setattr(fingerprint, "DIRECT", 0)
    monkeypatch.setattr(fingerprint, "materialize", lambda d, *a, f=fingerprint.materialize, **b: (seen.append(plan(d)), f(d, *a, **b))[1])
    fingerprint.nearest_code(df.where("doc_id < 100"), df.where("doc_id >= 100"), flips=2).count()
    assert len(seen) > 4 and not any("Broadcast" in x for x in seen)


def test_group_split_keeps_clusters_whole(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 97).alias("cluster_id"))
    split = fingerprint.group_split(df, 0.2)
    assert fingerprint.split_overlap(split).first().rows == 0
    val = split.where("split = 'val'").count()
    assert 100 <= val <= 106


def test_auc_with_ties_and_one_class(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")
    assert evaluate.roc_auc(df).first().auc == 0.875
    assert evaluate.roc_auc(df.where("y = 1")).first().auc is None


def test_youden_takes_the_highest_of_equal_thresholds(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.4), (0, 0.1)], "y int, p double")
    assert evaluate.youden(df).first().tau == 0.9


def test_published_kappa_form(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 2), (2, 2, 2), (1, None, 1)], "a int, b int, c int")
    got = evaluate.fleiss_kappa(df, ["a", "b", "c"], [0, 1, 2]).first()
    p, s = (1 + 1 / 3 + 1) / 3, [3 / 9, 2 / 9, 4 / 9]
    e = sum(x * x for x in s)
    assert got["items"] == 3
    assert got.kappa == pytest.approx((p - e) / (1 - e), abs=1e-6)


def test_metrics_of_nothing(spark):
    got = evaluate.binary_metrics(spark.createDataFrame([], "y int, pred int")).first()
    assert (got.accuracy, got.f1) == (0.0, 0.0)


def test_stratified_folds_are_even(spark):
    df = spark.range(503).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    counts = {(r.y, r.fold): r["count"] for r in evaluate.stratified_folds(df, "id").groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        sizes = [counts[y, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_balanced_sample_fills_up(spark):
    rows = [(f"a/{i:03d}", "a") for i in range(3)] + [(f"b/{i:03d}", "b") for i in range(50)] + [(f"c/{i:03d}", "c") for i in range(50)]
    got = curation.balanced_sample(spark.createDataFrame(rows, "path string, label string"), 30, "label", "path")
    n = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert n == {"a": 3, "b": 17, "c": 10}
    ids = [r.item_id for r in curation.number_rows(got, "image_", 3, "path").orderBy("path").collect()]
    assert ids == [f"image_{i:03d}" for i in range(1, 31)]


def test_dedup_exact_keeps_the_first(spark):
    df = spark.createDataFrame([("h", "b", "2"), ("h", "a", "9"), ("g", "a", "1")], "hash string, label string, path string")
    assert {(r.hash, r.path) for r in curation.dedup_exact(df, "hash", "label", "path").collect()} == {("h", "9"), ("g", "1")}
    with pytest.raises(ValueError):
        curation.require_rows(df, 4)


def test_terms_match_inside_words(spark):
    df = spark.createDataFrame([("Roadmap.jpg",), ("lake view.jpg",)], "f string")
    assert [r.x for r in df.select(curation.is_relevant(F.col("f")).alias("x")).collect()] == [False, True]
    assert df.limit(1).select(curation.has_extension(F.lit("a.JPG?w=1.gif")).alias("x")).first().x is True
    assert df.limit(1).select(curation.free_license(F.lit(" CC-BY-SA-3.0")).alias("x")).first().x is True


def test_alert_commands(spark):
    rows = [
        ("a", 1, "send", None, None), ("b", 1, "assign", 5, None), ("b", 2, "send", None, None), ("b", 3, "send", None, None), ("c", 1, "dismiss", None, "no"),
        ("c", 2, "assign", 4, None), ("c", 3, "send", None, None), ("d", 1, "assign", 1, None), ("d", 2, "send", None, None), ("d", 3, "dismiss", None, None),
    ]
    got = {r.alert_id: (r.status, r.recipient, r.errors) for r in alerts.fold(spark.createDataFrame(rows, "alert_id string, seq int, command string, authority_id int, reason string")).collect()}
    assert got == {"a": ("pending_review", None, 1), "b": ("sent", 5, 0), "c": ("dismissed", 4, 1), "d": ("dismissed", 1, 0)}


@pytest.mark.parametrize("run", [2, 5, 1024])
def test_fold_by_runs_equals_a_loop(spark, run, monkeypatch):
    monkeypatch.setattr(alerts, "RUN", run)
    rng = random.Random(run)
    rows = [(a, n, rng.choice(["assign", "send", "dismiss", "send", "odd"]), rng.choice([None, 1, 2]), rng.choice([None, "why"])) for a in range(30) for n in rng.sample(range(40), rng.randrange(1, 30))]
    want = {}
    for a, _, *c in sorted(rows, key=lambda r: r[:2]):
        want[a] = alert_states.step(want.get(a, ("pending_review", None, None, 0)), c[0], c[1], c[2])
    rng.shuffle(rows)
    got = alerts.fold(spark.createDataFrame(rows, "alert_id int, seq int, command string, authority_id int, reason string"))
    assert {r.alert_id: (r.status, r.recipient, r.note, r.errors) for r in got.collect()} == want
    assert alerts.fold(spark.createDataFrame([], "alert_id int, seq int, command string, authority_id int, reason string")).count() == 0


def test_fold_of_one_alert_with_a_million_commands(spark):
    n, some = 1_000_000, F.col("id") % 4
    kind = F.when(some == 0, "assign").when(some == 3, F.when(F.col("id") == 700_003, "dismiss").otherwise("other")).otherwise("send")
    rows = spark.range(n, numPartitions=8).select(F.lit("a").alias("alert_id"), F.col("id").alias("seq"), kind.alias("command"), (F.col("id") % 9).alias("authority_id"), F.lit(None).cast("string").alias("reason"))
    r = alerts.fold(rows).first()
    # the first send succeeds; after the dismissal every send fails
    assert (r.status, r.recipient, r.note, r.errors) == ("dismissed", (n - 4) % 9, None, sum(i % 4 in (1, 2) for i in range(700_004, n)))


def test_alert_lists_and_payloads(spark):
    rows = [(f"a{i}", i, 1, i % 2, "high", 50.5, "pending_review" if i % 3 else "sent", "s", "b", None, datetime(2024, 1, 1 + i % 5)) for i in range(300)]
    made = spark.createDataFrame(rows, "alert_id string, report_id long, water_body_id long, authority_ord int, risk_level string, composite_score double, status string, subject string, body string, send_note string, created_at timestamp")
    page = alerts.list_alerts(made, "sent", 1000).collect()
    assert [(r.created_at, r.alert_id) for r in page] == sorted(((r[10], r[0]) for r in rows if r[6] == "sent"), key=lambda x: (-x[0].day, x[1])) and {r.total for r in page} == {100}
    assert [r.total for r in alerts.list_alerts(made, None, 0).collect()] == [1] and alerts.list_alerts(made, None, 999).count() == 200
    who = spark.createDataFrame([(0, "Board", "x@y.z")], "ord int, name string, email string")
    got = {r.alert_id: json.loads(r.payload) for r in alerts.payload(made, who).collect()}
    assert got["a0"]["recipient"] == "x@y.z" and got["a1"]["recipient"] is None and got["a1"]["authority_id"] == 1 and got["a4"]["created_at"] == "2024-01-05T00:00:00" and got["a4"]["sent_at"] is None
    assert list(got["a0"]) == ["id", "report_id", "water_body_id", "authority_id", "recipient", "risk_level", "composite_score", "satellite_corroboration", "status", "channel", "subject", "body", "send_note", "created_at", "sent_at"]
    assert [(r.ord, r.total) for r in alerts.list_authorities(who).collect()] == [(0, 1)]


def test_pages_by_cursor_give_each_row_once(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i // 3)) for i in range(47)] + [(None, start), (99, None)]
    seen, cursor, k = [], None, 0
    while True:
        df = spark.createDataFrame(rows, "report_id long, created_at timestamp")
        page, cursor = reports.page_after(df, "created_at", cursor, 10)
        seen += [r.report_id for r in page.collect()]
        assert {r.total for r in page.collect()} <= {len(rows) - 2}
        if cursor is None:
            break
        k += 1
        rows.append((1000 + k, start + timedelta(days=k)))  # a newer report between two pages
    assert seen == [i for i, _ in sorted(rows[:47], key=lambda r: (r[1], r[0]), reverse=True)]


def test_authority_by_order_and_default(spark):
    bodies = spark.createDataFrame([(1, "Pune", "Goa"), (2, "Nowhere", None), (3, None, None)], "id long, city string, state string")
    who = spark.createDataFrame([(0, "D", None, True), (2, "City", " PUNE ", False), (1, "State", "goa", False)], "ord int, name string, jurisdiction string, is_default boolean")
    assert {r.id: r.authority_ord for r in alerts.match_authority(bodies, who).collect()} == {1: 1, 2: 0, 3: 0}


def test_polygons(spark):
    ring = [[0.1, 0.1], [0.9, 0.1], [0.5, 0.9]]
    regions = spark.createDataFrame([("t", "moderate", [ring]), ("none", "moderate", None), ("flat", "moderate", [[[0.1, 0.1], [0.2, 0.1]]])], "name string, category string, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.15, 0.8), (3, 0.5, 0.05), (4, 5.0, 5.0), (5, None, 0.5)], "id int, longitude double, latitude double")
    assert [r.id for r in spatial.in_region(points, regions).collect()] == [1]


@pytest.mark.parametrize("grid", [1, 7, 32])
def test_holes_and_parts_by_cells(spark, grid):
    rng = random.Random(grid)
    wave = lambda x, y, r, n: [[x + r * (1 + 0.3 * math.sin(7 * a)) * math.cos(a), y + r * (1 + 0.3 * math.sin(7 * a)) * math.sin(a)] for a in (2 * math.pi * k / n for k in range(n))]
    shapes = {"holed": [wave(0.5, 0.5, 0.4, 300), wave(0.5, 0.5, 0.15, 40)], "parts": [wave(1.2, 0.3, 0.1, 25), wave(1.9, -0.4, 0.2, 60), [[2.5, 0.0], [2.5, 0.5], [3.0, 0.5], [3.0, 0.0], [2.5, 0.0]]]}
    points = [(i, rng.uniform(-0.2, 3.2), rng.uniform(-0.8, 1.2)) for i in range(3000)]

    def lies(x, y, rings):
        n = 0
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
                n += (y1 > y) != (y2 > y) and x < (x2 - x1) * ((y - y1) / (y2 - y1)) + x1
        return n % 2

    regions = spark.createDataFrame([(k, "c", v) for k, v in shapes.items()], "name string, category string, rings array<array<array<double>>>")
    got = spatial.in_region(spark.createDataFrame(points, "id int, longitude double, latitude double").withColumn("row", F.lit("mine")), regions, grid=grid)
    assert got.columns == ["id", "longitude", "latitude", "row", "name", "category"]
    want = {(i, k) for i, x, y in points for k, v in shapes.items() if lies(x, y, v)}
    assert {(r.id, r.name) for r in got.collect()} == want and len(want) > 200
    cells = spatial.region_cells(regions, 32)[1]
    assert cells.where("inside and edges is not null").count() == 0 and cells.where("inside").count() > 100


def test_notes_of_a_task_are_bounded(spark, monkeypatch):
    """However many bodies and lakes there are, a task makes a stated volume of notes; all notes are there, and whole."""
    monkeypatch.setattr(satellite, "NOTE_BYTES", 5000)
    bodies = spark.range(400).select("id", F.concat(F.lit("Body "), "id").alias("name"))
    lakes = spark.range(60).select((F.col("id") + 1000).alias("lake_id"), F.format_string("Lake %03d", "id").alias("lake"), F.col("id").alias("ord"))
    matched = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, F.lit(1000)).alias("lake_id"))
    summary = spark.createDataFrame([(1000, 7)], "lake_id long, n_months long")
    got = satellite.availability(matched, bodies, summary, lakes)
    rows = got.select("*", F.spark_partition_id().alias("task")).collect()
    names = ", ".join(f"Lake {i:03d}" for i in range(60))
    assert {r.id: (r.available, r.n_months, r.note) for r in rows} == {i: (i % 2 == 0, 7 * (i % 2 == 0), None if i % 2 == 0 else f"'Body {i}' is not tracked. Tracked lakes (60): {names}") for i in range(400)}
    by_task = {}
    for r in rows:
        by_task[r.task] = by_task.get(r.task, 0) + len(r.note or "")
    assert max(by_task.values()) < 5 * 5000 and len(rows) == 400


def test_point_metrics_count_a_place_once(spark, monkeypatch):
    """Many points at one place, scenes that only a wider radius has, scenes without a number, points without a place; against a plain count."""
    from statistics import median

    rng = random.Random(4)
    places = [(12.9, 77.5), (12.903, 77.5), (13.4, 77.9), (14.0, 78.0)]
    points = [(i, *places[i % 4]) for i in range(60)] + [(60, None, 77.5)]
    px = [
        (12.9 + rng.uniform(-0.005, 0.005), 77.5 + rng.uniform(-0.005, 0.005), rng.randrange(40), rng.choice([None, *range(30)]), "2024-01-10", 10.0, float(rng.randrange(10, 40)), float(rng.randrange(5, 30)), float(rng.randrange(5, 30)), float(rng.randrange(10, 40)), rng.randrange(12))
        for _ in range(600)
    ] + [(13.4, 77.9, 1, 5, "2024-01-10", 10.0, 30.0, 5.0, 6.0, 10.0, 6)]
    names = ["latitude", "longitude", "pixel_id", "scene_id", "sensed_date", "cloudy_pct", "b3", "b4", "b5", "b8", "scl"]
    pixels = spark.createDataFrame(px, "latitude double, longitude double, pixel_id int, scene_id int, sensed_date string, cloudy_pct double, b3 double, b4 double, b5 double, b8 double, scl int").withColumn("sensed_date", F.to_date("sensed_date"))
    seen, within = [], spatial.within_radius
    monkeypatch.setattr(spatial, "within_radius", lambda a, others, *rest: (seen.append(others.count()), within(a, others, *rest))[1])
    got = {r.id: r for r in spatial.point_metrics(spark.createDataFrame(points, "id int, latitude double, longitude double"), pixels, "2024-01-31 00:00:00").collect()}
    assert len(got) == 61 and seen[0] <= 5

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * K.EARTH_RADIUS * math.asin(min(1, math.sqrt(h)))

    for i, lat, lon in points:
        want, most = (None,) * 4, 0
        for radius in K.BUFFERS:
            near = [dict(zip(names, x, strict=True)) for x in px if lat is not None and metres(lat, lon, x[0], x[1]) <= radius]
            scenes = len({x["scene_id"] for x in near} - {None})
            most = max(most, scenes)
            by = {}
            for x in near:
                if x["scl"] not in K.MASKED_SCL:
                    by.setdefault(x["pixel_id"], []).append(x)
            m = [[median(x[b] for x in v) for b in ("b3", "b4", "b5", "b8")] for v in by.values()]
            ndci = [(b5 - b4) / (b5 + b4) for b3, b4, b5, b8 in m if b3 > b8]
            if want[0] is None and len(ndci) >= K.MIN_WATER_PIXELS:
                want = (round(sum(ndci) / len(ndci), 4), len(ndci), radius, scenes)
        r = got[i]
        assert (r.water_pixel_count, r.buffer_m, r.scenes_used) == want[1:] and (r.live_ndci is None) == (want[0] is None)
        assert want[0] is None or abs(r.live_ndci - want[0]) < 1e-3
        assert r.reason == (None if want[0] is not None else "sub_pixel_or_no_water" if most else "cloud_cover_or_timeout")
    assert {got[0].available, got[2].available, got[60].available} == {True, False} and got[1].scenes_used is not None


def test_regions_of_all_sizes_are_found_by_squares_of_theirs(spark):
    """Small rings are a cell or two and not a grid of a thousand; boxes from metres to a hemisphere, across zero, points on no square's edge or on it."""
    rng = random.Random(3)
    square = lambda x, y, r: [[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r]]
    shapes = {f"s{i}": [square(rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), r)] for i, r in enumerate([0.0003, 0.004, 0.02, 0.1, 0.25, 3.0, 50.0] * 6)}
    shapes["line"] = [[[0.1, 0.1], [0.1, 0.1], [0.1, 0.1]]]
    regions = spark.createDataFrame([(k, "c", v) for k, v in shapes.items()], "name string, category string, rings array<array<array<double>>>")
    points = [(i, rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)) for i in range(1500)] + [(1500 + i, v[0][0][0] + 0.0001, v[0][0][1] + 0.0001) for i, v in enumerate(shapes.values())] + [(9000, 0.0, 0.0), (9001, 0.25, -0.25), (9002, None, 0.0)]
    inside = lambda x, y, v: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * ((y - a[1]) / (b[1] - a[1])) + a[0] for a, b in zip(v, v[1:] + v[:1], strict=True)) % 2
    want = {(i, k) for i, x, y in points if x is not None for k, v in shapes.items() if inside(x, y, v[0])}
    px = spark.createDataFrame(points, "id int, longitude double, latitude double")
    for most in (500_000, 0):
        assert {(r.id, r.name) for r in spatial.in_region(px, regions, most=most).collect()} == want and len(want) > 5000
    assert spatial.region_cells(regions)[1].count() <= 9 * len(shapes)


def test_match_lake_prefers_the_exact_name(spark):
    lakes = spark.createDataFrame([(1, "Ulsoor Lake", 1), (2, "ULSOOR", 2), (3, "Ulsoor", 3)], "lake_id int, lake string, ord int")
    bodies = spark.createDataFrame([(1, "Ulsoor"), (2, "ulsoor reservoir"), (3, None), (4, "x")], "id int, name string")
    assert {r.id: r.lake_id for r in satellite.match_lake(bodies, lakes).collect()} == {1: 3, 2: 1, 3: None, 4: None}


def test_notes_name_all_tracked_lakes(spark):
    lakes = spark.createDataFrame([(1, "b", 1), (2, "B", 2), (3, None, 3), (4, "b", 4), (5, "a, c", 5)], "lake_id int, lake string, ord int")
    bodies = spark.createDataFrame([(1, "b"), (2, "x"), (3, None), (4, "a, c")], "id int, name string")
    summary = spark.createDataFrame([(1, 7)], "lake_id int, n_months long")
    rows = lambda tracked: {r.id: tuple(r)[1:] for r in satellite.availability(satellite.match_lake(bodies, lakes), bodies, summary, tracked).collect()}
    note = lambda name: f"'{name}' is not tracked. Tracked lakes (3): B, a, c, b"
    assert rows(lakes) == {1: (True, "water_detected", 7, None), 2: (False, "unknown", 0, note("x")), 3: (False, "unknown", 0, note("")), 4: (False, "unknown", 0, note("a, c"))}
    assert {r[3] for r in rows(lakes.where("lake is null")).values()} == {None}  # as the SQL has it


def test_months_without_scenes_stay(spark):
    rows = [(1, 1, 1, "2024-01-05", 5.0, 30.0, 10.0, 14.0, 20.0, 6, "polluted"), (1, 1, 2, "2024-03-05", 5.0, 30.0, 10.0, 14.0, 20.0, 9, "polluted")]
    px = spark.createDataFrame(rows, "lake_id int, pixel_id int, scene_id int, sensed_date string, cloudy_pct double, b3 double, b4 double, b5 double, b8 double, scl int, category string").withColumn("sensed_date", F.to_date("sensed_date"))
    got = {r.date: (r.ndci_mean, r.water_px, r.n_scenes) for r in satellite.monthly_ndci(px).collect()}
    assert got == {"2024-01": (pytest.approx(4 / 24), 1, 1), "2024-02": (None, 0, 0), "2024-03": (None, 0, 1)}


def test_validation_names_the_first_failure(spark):
    rows = [(91.0, 0.0, "foam"), (0.0, 181.0, "odd"), (0.0, 0.0, "odd"), (None, 0.0, "foam"), (1.0, 1.0, "foam")]
    good, bad = reports.validate(spark.createDataFrame(rows, "latitude double, longitude double, contamination_type string"))
    assert good.count() == 1
    assert sorted(r.reject_reason for r in bad.collect()) == ["latitude out of range", "latitude out of range", "longitude out of range", "unknown contamination type"]


@pytest.mark.parametrize("bands", [3, 4])
def test_near_codes_lose_no_pair(spark, bands):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(8)]
    codes = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(13))) for b in base for _ in range(12)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    got = {(r.a, r.b, r.d) for r in fingerprint.near_codes(df, df, 10, bands).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b, d) for a in signed for b in signed if (d := ((a ^ b) & mask).bit_count()) <= 10}
    assert fingerprint.band_number(10_000, 10) == 4
    assert fingerprint.band_number(10**9, 10) == 3


@pytest.mark.parametrize(("flips", "block", "direct"), [(3, 2048, 0), (1, 30, 0), (3, 30, 1 << 20)])
def test_nearest_code_is_exact(spark, flips, block, direct, monkeypatch):
    """Near ones by flipped bits, far ones in blocks; equal codes, ties by key, null codes."""
    monkeypatch.setattr(fingerprint, "FAR_BLOCK", block)
    monkeypatch.setattr(fingerprint, "DIRECT", direct)
    rng = random.Random(9)
    train = [rng.getrandbits(64) for _ in range(300)]
    val = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(22))) for c in train[:60]] + [rng.getrandbits(64) for _ in range(20)] + train[:3]
    signed = lambda c: c - 2**64 if c >> 63 else c
    rows = lambda codes, start: spark.createDataFrame([(start + i, signed(c)) for i, c in enumerate(codes)] + [(start + 900, None)], "doc_id long, code long")
    known = train + train[::-1]
    got = {r.doc_id: (r.distance, r.nearest) for r in fingerprint.nearest_code(rows(val, 0), rows(known, 1000), flips=flips).collect()}
    assert got.pop(900) == (None, None)
    assert got == {i: min(((c ^ h).bit_count(), 1000 + k) for k, h in enumerate(known)) for i, c in enumerate(val)}
    none = fingerprint.nearest_code(rows(val, 0), rows([], 1000), flips=flips)
    assert none.where("distance is not null or nearest is not null").count() == 0 and none.count() == len(val) + 1


def test_detections_of_an_image(spark):
    rows = spark.createDataFrame(
        [(1, 2, "turbid", 0.8), (1, 1, "clean", 0.8), (1, 3, "polluted", 0.4), (1, 4, None, 0.1), (2, 1, "clean", None), (3, 1, None, 0.5)],
        "conv_id int, turn int, class string, confidence double",
    )
    got = {r.conv_id: r for r in photo.detections(rows).collect()}
    assert (got[1].n, got[1].top_class, got[1].top_confidence, got[1].pollution_confidence) == (4, "clean", 0.8, 0.4)
    assert got[1].class_counts == {"clean": 1, "polluted": 1, "turbid": 1} and got[1].summary == "4 detections, top clean 80%"
    assert (got[2].n, got[2].top_class, got[2].top_confidence, got[2].pollution_confidence) == (1, "clean", None, 0.0)
    assert (got[3].top_class, got[3].class_counts) == (None, {})
    assert photo.detections(rows.where("false")).count() == 0


def _plain_clusters(pixels, k=3, steps=20):
    """The largest of ``k`` clusters, colour by colour."""
    from collections import Counter

    counts = sorted(Counter(pixels).items())
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    centres = [max(counts, key=lambda cn: cn[1])[0]]
    while len(centres) < k:
        centres.append(max(counts, key=lambda cn: min(d(cn[0], c) for c in centres))[0])
    for step in range(steps + 1):
        groups = [[] for _ in range(k)]
        for c, n in counts:
            groups[min(range(k), key=lambda j: d(c, centres[j]))].append((c, n))
        sizes = [sum(n for _, n in g) for g in groups]
        if step < steps:
            centres = [tuple(sum(c[i] * n for c, n in g) / s for i in range(3)) if s else old for g, s, old in zip(groups, sizes, centres, strict=True)]
    top = sizes.index(max(sizes))
    return max(sizes), *[int(x) for x in centres[top]]


def test_dominant_clusters_by_a_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    images = {k: [tuple(rng.choice(range(0, 256, rng.choice([1, 64]))) for _ in range(3)) for _ in range(64)] for k in range(12)}
    images[20] = [(7, 8, 9)] * 64  # one colour
    images[21] = [(0, 0, 0)] * 32 + [(255, 255, 255)] * 32  # two, equally many
    rows = [(k, 1 + i % 8, 1 + i // 8, 10, 10, *c) for k, p in images.items() for i, c in enumerate(p)]
    rows += [(k, 0, 5, 10, 10, 255, 0, 0) for k in images]  # the edge doesn't count
    rows += [(30, 1 + i, 1, 10, 10, None, 1, 1) for i in range(8)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, width int, height int, r int, g int, b int").withColumns({"c": F.lit(1), "n": F.lit(2), "colours": F.lit(3)})
    want = {k: _plain_clusters(p) for k, p in images.items()}
    for some in (photo.COLOURS, 100):  # many images at a time, or few
        monkeypatch.setattr(photo, "COLOURS", some)
        got = {r.image_id: (r.n, r.r, r.g, r.b) for r in photo.dominant_cluster(df).collect()}
        assert got == want
    assert photo.dominant_cluster(df.limit(0)).count() == 0


def test_dense_cells_are_dealt_over_tasks(spark):
    """Half of all reports lie in one cell, many of them at one place; no task has twice the median, and no row is lost."""
    rng = random.Random(8)
    rows = [(k, 12.90001, 77.50001) for k in range(4000)] + [(4000 + k, 12.9 + rng.random() * 0.004, 77.5 + rng.random() * 0.004) for k in range(4000)]
    rows += [(8000 + k, 13 + rng.random(), 77.5 + rng.random()) for k in range(8000)]
    points = spark.createDataFrame(rows, "report_id long, latitude double, longitude double").repartition(4)
    bodies = spark.createDataFrame([(k, 12.9 + rng.random() * 0.003, 77.5 + rng.random() * 0.003, 1) for k in range(3)] + [(9 + k, 13 + rng.random(), 77.5 + rng.random(), 1) for k in range(200)], "id long, latitude double, longitude double, parts int")
    key = lambda df: sorted((r.report_id, r.body_id, r.distance) for r in df.collect())
    assert key(spatial.nearest_within(points, bodies, dense=100)) == key(spatial.nearest_within(points, bodies, dense=None))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tasks = lambda dense: sorted(r.n for r in spatial.within_radius(points, bodies.where("id < 9"), 500.0, dense).groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("report_id").alias("n")).collect())
        assert len(tasks(None)) < 4
        dealt = tasks(100)
        assert len(dealt) == 4 and dealt[-1] <= 2 * (dealt[1] + dealt[2]) / 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    cut = {r.n for r in spatial.dense_cells(points, 500.0, 100).agg(F.count("*").alias("n")).collect()}
    assert 1 <= cut.pop() < 20
