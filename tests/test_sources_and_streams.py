"""Sources and sinks round trip; a stream's result is the batch's."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnlight.operators import alerts, satellite
from tarnlight.operators.reports import body_state, scored
from tarnlight.plans.adapters import Tables
from tarnlight.sources import tables as S
from tarnlight.streaming import alert_states, enrichment, state, streams

SF = "/root/testdata/sf0.001"


def test_entity_defaults_and_schema_evolution(spark, tmp_path):
    spark.range(2).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name"), F.lit(1).alias("extra")).write.parquet(f"{tmp_path}/b")
    row = S.read_table(spark, f"{tmp_path}/b", "water_bodies").first()
    assert (row.type, row.current_risk_level, row.total_reports, row.latitude, row.extra) == ("lake", "low", 0, None, 1)


def test_lenient_series(spark, tmp_path):
    (tmp_path / "m.csv").write_text("lake,category,date,ndci_mean,water_px,n_scenes\nA,polluted,2024-01,0.5,3,1\nA,,2024-02,None,,\nB,,2024-02,x,1,1\nB,,2024-03,-0.1,7,2\n")
    rows = S.read_ndci_monthly(spark, str(tmp_path / "m.csv")).orderBy("lake").collect()
    assert [(r.lake, r.category, r.ndci_mean, r.water_px) for r in rows] == [("A", "polluted", 0.5, 3), ("B", "unknown", -0.1, 7)]


def test_columns_and_labels(spark, tmp_path):
    (tmp_path / "v.csv").write_text("filename,annotator_1,annotator_2,annotator_3\na.jpg,0,2,\nb.jpg,EXCLUDE,1.0,1\nc.jpg,,,\n")
    rows = S.resolve_columns(S.read_csv(spark, str(tmp_path / "v.csv"))).orderBy("image_id").collect()
    assert [(r.image_id, r.label) for r in rows] == [("a.jpg", 2), ("b.jpg", 1), ("c.jpg", None)]


def test_regions_and_files(spark, tmp_path):
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "L"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    row = S.read_regions(spark, str(tmp_path / "g.json")).first()
    assert (row.name, row.category, row.rings) == ("L", "unknown", [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]])
    os.makedirs(tmp_path / "set" / "good")
    (tmp_path / "set" / "good" / "a.JPG").write_bytes(b"x")
    (tmp_path / "set" / "good" / "b.txt").write_bytes(b"y")
    assert [r.label for r in S.read_labelled_files(spark, str(tmp_path / "set"), ("jpg",)).collect()] == ["good"]


def test_cached_tables_reports_and_appends(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for recompute in (False, False, True):
        assert S.load_or_compute(spark, f"{tmp_path}/c", make, recompute).count() == 3
    assert len(made) == 2
    assert S.read_report(spark, f"{tmp_path}/none", "level string").first().status == "NOT RUN"
    S.write_report(spark.range(1).select(F.lit("LOW").alias("level")), f"{tmp_path}/r")
    assert tuple(S.read_report(spark, f"{tmp_path}/r", "level string").first()) == ("LOW", "ok")
    for _ in range(2):
        S.append_new(spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "name string, v int"), f"{tmp_path}/a", "name")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    S.write_split(spark.range(10).withColumn("split", F.col("id") % 2), f"{tmp_path}/s", "split", "id")
    assert sorted(x for x in os.listdir(tmp_path / "s") if x.startswith("split")) == ["split=0", "split=1"]


def test_appends_by_batch(spark, tmp_path):
    """Unfinished and repeated batches, two writers at one time, rows without a key."""
    path, schema = f"{tmp_path}/t", "name string, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    got = lambda key=None: sorted((str(r.name), r.v) for r in S.appended(spark, path, key).collect())
    with pytest.raises(ValueError):
        S.appended(spark, path)
    S.append_new(rows(("a", 1), ("b", 2)), path, "name", "first")
    S.append_new(rows(("b", 3), ("c", 4)), path, "name", "second")
    assert got() == [("a", 1), ("b", 2), ("c", 4)]
    # a write that failed: rows without a mark of success; the next try takes its place
    rows(("d", 5)).write.parquet(f"{path}/appended_in=third")
    os.remove(f"{path}/appended_in=third/_SUCCESS")
    assert got() == [("a", 1), ("b", 2), ("c", 4)]
    for _ in range(2):
        S.append_new(rows(("d", 6), ("a", 7)), path, "name", "third")
        S.append_new(rows(("a", 1), ("b", 2)), path, "name", "first")
    assert got() == got("name") == [("a", 1), ("b", 2), ("c", 4), ("d", 6)]
    # what a writer brings that began before another had finished
    rows(("e", 8)).write.parquet(f"{path}/appended_in=u1")
    rows(("e", 9), ("f", 10)).write.parquet(f"{path}/appended_in=u2")
    assert got("name") == [("a", 1), ("b", 2), ("c", 4), ("d", 6), ("e", 8), ("f", 10)] and len(got()) == 7
    S.append_new(rows((None, 11), (None, 11)), path, "name")
    S.append_new(rows((None, 12)), path, "name")
    assert [v for n, v in got("name") if n == "None"] == [11, 12]
    S.append_new(rows(), path, "name")
    assert len(got("name")) == 8
    with pytest.raises(ValueError):
        S.append_new(rows(("a", 1)).withColumn("appended_in", F.lit(1)), path, "name")


def _stream(spark, tmp_path, name):
    batch = Tables(spark, SF)["v_reports"]
    batch.repartition(4).write.parquet(f"{tmp_path}/{name}")
    return batch, spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/{name}")


def test_rolling_counts_stream_equals_batch(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path, "in")
    streams.run_to_table(streams.rolling_counts(stream, "60 days"), "rolling", f"{tmp_path}/cp", "complete")
    key = lambda df: sorted((r.water_body_id, r.window_start, r.n) for r in df.collect())
    assert key(spark.table("rolling")) == key(streams.rolling_counts(batch))


def test_ingest_stream_equals_batch_and_replays(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path, "reports")
    bodies = Tables(spark, SF)["v_bodies"]
    streams.ingest(stream, bodies, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/reports").count() + spark.read.parquet(f"{tmp_path}/out/rejected").count()
    assert got == batch.count()
    before = streams.ingested_state(spark, f"{tmp_path}/out").count()
    streams.ingest_batch(bodies, f"{tmp_path}/out")(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/out/reports").count() + spark.read.parquet(f"{tmp_path}/out/rejected").count() == got
    assert streams.ingested_state(spark, f"{tmp_path}/out").count() == before


def test_several_batches_make_the_bodies_of_one(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batch = Tables(spark, SF)["v_reports"].limit(1)
    rng = random.Random(4)
    rows = [(i, 20.0 + rng.choice([0, 0.003, 0.006]) + rng.uniform(0, 0.003), 80.0 + rng.uniform(0, 0.012), start + timedelta(minutes=i)) for i in range(90)]
    places = spark.createDataFrame(rows, "report_id long, latitude double, longitude double, created_at timestamp")
    kind = batch.select(*[c for c in batch.columns if c not in places.columns]).withColumn("contamination_type", F.lit("sewage"))
    reports = places.crossJoin(kind).select(batch.columns)
    bodies = Tables(spark, SF)["v_bodies"]
    streams.ingest_batch(bodies, f"{tmp_path}/one")(reports, 0)
    write = streams.ingest_batch(bodies, f"{tmp_path}/three")
    for k in (0, 1, 1, 2):  # the second one again, as after a failure
        write(reports.where(F.floor(F.col("report_id") / 30) == k), k)
    of = lambda name: {r.report_id: (r.matched_body_id, r.body_name) for r in spark.read.parquet(f"{tmp_path}/{name}/reports").collect()}
    one = of("one")
    assert of("three") == one
    assert len(one) == 90
    made = {r.founder for r in spark.read.parquet(f"{tmp_path}/three/bodies").collect()}
    assert {f"new-{i}" for i in made} == {b for b, _ in one.values()}
    assert 1 < len(made) < 40


def test_kept_state_equals_a_full_count_after_each_batch(spark, tmp_path):
    """W7 from the kept state, after each of several batches, one replayed, with whole states in between."""
    reports = scored(Tables(spark, SF)["v_reports"]).select("report_id", "water_body_id", "created_at", "composite_score", "risk_level").cache()
    key = lambda df: sorted((r.water_body_id, r.total_reports, r.last_report_at, r.current_risk_score, r.current_risk_level) for r in df.withColumn("water_body_id", F.col("water_body_id").cast("string")).collect())
    path, part = f"{tmp_path}/state", F.pmod(F.xxhash64("report_id"), F.lit(5))
    assert state.current_state(spark, path).count() == 0
    for k in (0, 1, 1, 2, 3, 3, 4):
        state.merge_batch(reports.where(part == k), path, k, compact=2)
        assert key(state.current_state(spark, path)) == key(body_state(reports.where(part <= k)))
    assert key(state.current_state(spark, path, upto=3)) == key(body_state(reports.where(part <= 2)))
    assert sorted(x for x in os.listdir(f"{path}/whole") if x.startswith("batch")) == ["batch=1", "batch=3"]
    # the state is opened by bucket and batch, not as a whole
    plan = state._versions(spark, path, 5).where(F.col("bucket").isin([3])).groupBy("bucket").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(batch") == 2 and plan.count("(bucket#") >= 2
    state.merge_batch(reports.limit(0), path, 5, compact=2)
    assert key(state.current_state(spark, path)) == key(body_state(reports))
    # versions that the last but one whole state has taken over are gone
    assert sorted(x for x in os.listdir(f"{path}/whole") if x.startswith("batch")) == ["batch=3", "batch=5"]
    assert sorted(x for x in os.listdir(f"{path}/changes") if x.startswith("batch")) == ["batch=4", "batch=5"]


def test_ingest_takes_each_report_once(spark, tmp_path):
    """Reports that come again, in a batch and in later ones, and reports without id or on no place."""
    batch = Tables(spark, SF)["v_reports"].where("contamination_type = 'sewage'").limit(40).cache()
    bodies = Tables(spark, SF)["v_bodies"].limit(0)
    write = streams.ingest_batch(bodies, f"{tmp_path}/out")
    write(batch.unionByName(batch.limit(10)), 0)
    write(batch.unionByName(Tables(spark, SF)["v_reports"].where("contamination_type = 'foam'").limit(20)), 1)
    got = spark.read.parquet(f"{tmp_path}/out/reports")
    assert got.count() == got.select("report_id").distinct().count() == 60
    assert streams.ingested_state(spark, f"{tmp_path}/out").agg(F.sum("total_reports")).first()[0] == 60
    made = spark.read.parquet(f"{tmp_path}/out/bodies")
    assert {(r.type, r.city, r.state) for r in made.collect()} == {("unknown", "Unknown", "Unknown")} and made.where("created_at is null or updated_at is null").count() == 0


def test_stream_of_repeated_reports(spark, tmp_path):
    batch = Tables(spark, SF)["v_reports"].where("contamination_type = 'sewage'").limit(30)
    for k in range(2):
        batch.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in/*")
        streams.ingest(stream, Tables(spark, SF)["v_bodies"], f"{tmp_path}/out", f"{tmp_path}/check", "400 days").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/reports")
    assert got.count() == got.select("report_id").distinct().count() == 30


def test_alert_commands_out_of_order_as_a_stream(spark, tmp_path):
    """H3: after all batches the stream's states are the batch's, in whatever order commands come; folded ones leave the state."""
    rng = random.Random(6)
    kinds = ["assign", "send", "dismiss", "send"]
    rows = [(f"a{a}", n, rng.choice(kinds), rng.choice([None, 1, 2]), rng.choice([None, "why"]), datetime(2024, 1, 1) + timedelta(hours=n)) for a in range(6) for n in range(40)]
    schema = "alert_id string, seq long, command string, authority_id long, reason string, at timestamp"
    # commands come up to eight numbers too early or too late
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 8))
    config = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k, None) for k in config}
    try:
        for k, v in config.items():
            spark.conf.set(k, v)
        for k in range(3):
            spark.createDataFrame(rows[k * 80 : k * 80 + 80], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            q = alert_states.alert_states(stream, "12 hours").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp")
            q.foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={b}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    last = {r.alert_id: (r.status, r.recipient, r.note, r.errors, r.commands) for r in sorted(out, key=lambda r: r.batch)}
    want = {r.alert_id: (r.status, r.recipient, r.note, r.errors, 40) for r in alerts.fold(spark.createDataFrame(rows, schema)).collect()}
    assert last == want


def test_late_rows_and_weeks_as_a_stream(spark, tmp_path):
    """H5: what comes later than the watermark allows isn't counted. H6: weeks as a stream are those of the table."""
    rows = [(k, 1, datetime(2024, 1, d), 10.0 * k, 1.0, 2.0, 3.0) for k, d in ((1, 2), (2, 3), (3, 30), (4, 31))] + [(5, 1, datetime(2024, 1, 4), 1.0, 1.0, 1.0, 1.0)]
    schema = "report_id long, water_body_id long, created_at timestamp, composite_score double, algae_percentage double, foam_coverage_pct double, turbidity_score double"
    for name, part in (("a", rows[:4]), ("b", rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        q = streams.rolling_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.window_start.day, r.window_start.month): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[2, 1] == 2  # two rows in time; the one of the fourth came after the watermark had passed
    weeks = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    streams.run_to_table(streams.weekly_snapshots(weeks, "60 days"), "weeks", f"{tmp_path}/cw", "complete")
    key = lambda df: sorted((r.window_start, r.report_count, r.risk_score) for r in df.collect())
    assert key(spark.table("weeks")) == key(streams.weekly_snapshots(spark.createDataFrame(rows, schema)))


_RESULT = "report_id long, checked_at timestamp, failed boolean, available boolean, live_ndci double, latest_ndci double, exceeds boolean, spatial_confidence string, corroboration string, mode string"


def _look_ups():
    """Reports of two hours, and look-ups that answer in time, on the last minute, too late, twice, never, for nobody, or fail."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    reports = [(k, at(k * 10), f"n{k}") for k in range(12)] + [(3, at(30), "n3"), (None, at(5), "no id"), (90, None, "no time")]
    answer = lambda k, after, failed=False, there=True: (k, at(k * 10 + after), failed, there, None, 0.1 * k, k % 2 == 0, None, "watch", "cached_lake")
    results = [answer(0, 5), answer(1, 60), answer(2, 61), answer(3, 1), answer(3, 1), answer(4, 2, failed=True), answer(5, 2, there=False), answer(6, 0), answer(7, -1), answer(400, 3)]
    results += [(None, at(1), False, True, 0.1, 0.1, True, None, "watch", "cached_lake"), (8, None, False, True, 0.1, 0.1, True, None, "watch", "cached_lake"), (9, at(95), None, None, 0.3, 0.1, None, None, None, None)]
    want = {0: "done", 1: "done", 2: "error", 3: "done", 4: "error", 5: "unavailable", 6: "done", 7: "error", 8: "error", 9: "unavailable", 10: "error", 11: "error", None: "error", 90: "error"}
    return reports, results, want


def test_settled_reports_of_tables(spark):
    reports, results, want = _look_ups()
    # names that the operator uses itself, and one that the look-up writes
    schema = "report_id long, created_at timestamp, answer string"
    left = spark.createDataFrame(reports, schema).withColumns({"id": F.lit(1), "at": F.lit(2), "row": F.lit(3), "of": F.lit(4), "then": F.lit(5), "_n": F.lit(6), "available": F.lit(7), "satellite_status": F.lit("old")})
    right = spark.createDataFrame(results, _RESULT)
    out = enrichment.settle(left, right)
    rows = out.collect()
    assert sorted((str(r.report_id), r.satellite_status) for r in rows) == sorted((str(k), v) for k, v in want.items())
    assert {(r.id, r.at, r.row, r.of, r.then, r._n, r.available) for r in rows} == {(1, 2, 3, 4, 5, 6, 7)}
    by = {r.report_id: r for r in rows}
    assert by[1].satellite_ndci == 0.1 and by[1].answer == "n1" and by[9].satellite_ndci == 0.3
    assert by[4].satellite_ndci is None and by[2].satellite_checked_at is None
    now = {r.report_id: r.satellite_status for r in enrichment.lifecycle(left, out.where("report_id < 4")).collect()}
    assert now == {k: (want[k] if k < 4 else "processing") for k in want if k is not None}
    assert enrichment.settle(left.limit(0), right).count() == 0
    assert {r.satellite_status for r in enrichment.settle(left, right.limit(0)).collect()} == {"error"}
    assert {r.satellite_status for r in enrichment.processing(left).collect()} == {"processing"}


def test_settled_reports_of_streams(spark, tmp_path):
    """H1: the streams settle each report as the tables do; no error comes before the watermark passes."""
    reports, results, want = _look_ups()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        end = datetime(2024, 1, 3)
        steps = [(reports[:6], results[:3]), (reports[6:], results[3:]), ([(500, end, "last")], [(501, end, False, True, 0.1, 0.1, True, None, "watch", "cached_lake")])]
        errors = []
        for k, (a, b) in enumerate(steps):
            spark.createDataFrame(a, "report_id long, created_at timestamp, note string").coalesce(1).write.parquet(f"{tmp_path}/reports/{k}")
            spark.createDataFrame(b, _RESULT).coalesce(1).write.parquet(f"{tmp_path}/results/{k}")
            read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/*")
            out = enrichment.settle(read("reports", "report_id long, created_at timestamp, note string"), read("results", _RESULT), late="2 hours")
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
            errors.append(spark.read.parquet(f"{tmp_path}/out").where("satellite_status = 'error' and report_id is not null and report_id < 90").count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted((str(r.report_id), r.satellite_status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((str(k), v) for k, v in want.items())  # the last report still waits
    assert errors[:2] == [0, 1] and errors[2] == 6  # a failed look-up is known at once, the missing ones when no answer can come


def test_months_kept_by_folder(spark, tmp_path):
    """A10: a new scene rewrites the folder of its month and lake alone; the table equals a full count after each refresh."""
    px = Tables(spark, SF)["v_pixels"].cache()
    path = f"{tmp_path}/months"
    key = lambda df: sorted((r.lake_id, r.category, r.date, r.ndci_mean, r.water_px, r.n_scenes) for r in df.collect())
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    one = px.where("cloudy_pct < 20").orderBy("scene_id", "lake_id", "pixel_id").first()
    same = (F.col("scene_id") == one.scene_id) & (F.col("lake_id") == one.lake_id) & (F.col("sensed_date") == F.lit(one.sensed_date))
    old = px.where(~same)
    satellite.refresh_months(old, old, path, folders=2)
    assert key(satellite.kept_months(spark, path)) == key(satellite.monthly_ndci(old))
    before = files()
    satellite.refresh_months(px, px.where(same), path, folders=2)
    after = files()
    assert key(satellite.kept_months(spark, path)) == key(satellite.monthly_ndci(px))
    changed = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(changed) == 1 and f"date={one.sensed_date:%Y-%m}" in next(iter(changed))
    satellite.refresh_months(px, px.where(same), path, folders=2)
    satellite.refresh_months(px, px.limit(0), path, folders=2)
    assert key(satellite.kept_months(spark, path)) == key(satellite.monthly_ndci(px))
    # a lake that is known by undated pixels alone
    lost = px.limit(1).withColumns({"lake_id": F.lit(10**6).cast(px.schema["lake_id"].dataType), "sensed_date": F.lit(None).cast(px.schema["sensed_date"].dataType)})
    more = px.unionByName(lost)
    satellite.refresh_months(more, lost, path, folders=2)
    assert key(satellite.kept_months(spark, path)) == key(satellite.monthly_ndci(more))
