import pytest
from pyspark.sql import functions as F

from panelcast import fixed
from panelcast.operators.impute import fill_within
from panelcast.plans import histories as H, predict as D
from panelcast.session import shared_folder
from panelcast.sources import landed as L, stores as K
from panelcast.spec import PanelSpec
from panelcast.streaming import jobs as J

AIR = PanelSpec(absent=fixed.ABSENT)
ONE = PanelSpec(measures=("m1",))


def text(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_station_wide_files(spark, tmp_path):
    text(tmp_path / "all/20180101.csv", "date,hour,type,东四,天坛", "20180101,8,PM2.5,1,2", "20180101,8,PM10,3,", "20180101,8,AQI,9,9")
    text(tmp_path / "all/20180102.csv", "date,hour,type,东四,天坛", "20180101,8,PM2.5,7,8")
    text(tmp_path / "extra/20180101.csv", "date,hour,type,tiantan_aq,dongsi_aq", "20180101,8,O3,5,6")
    out = L.read_station_wide(
        spark, [f"{tmp_path}/all", f"{tmp_path}/extra"], AIR, fixed.BEIJING_STATIONS, fixed.BEIJING_HEADERS,
        utc_offset_hours=fixed.BEIJING_UTC_OFFSET_HOURS,
    )
    found = {r.station: (str(r.ts), r.pm25, r.pm10, r.o3) for r in out.collect()}
    assert found == {
        "dongsi_aq": ("2018-01-01 00:00:00", 7.0, 3.0, 6.0),  # the later file wins
        "tiantan_aq": ("2018-01-01 00:00:00", 8.0, None, 5.0),
    }


def test_station_files_with_their_own_headers(spark, tmp_path):
    text(
        tmp_path / "BL0_01jan2018.csv",
        "MeasurementDateGMT,Bloomsbury: Nitrogen (ug/m3),Bloomsbury: PM10 Particulate (ug/m3),Bloomsbury: PM2.5 Particulate (ug/m3)",
        "2018-01-01 00:00,1,20.5,10.5",
        "2018-01-01 01:00,1,,11.5",
    )
    text(
        tmp_path / "CD1_01jan2018.csv",
        "MeasurementDateGMT,Camden: PM2.5 Particulate (ug/m3)",
        "2018-01-01 00:00,3.5",
    )
    text(tmp_path / "BL0_01feb2018.csv", "MeasurementDateGMT,B: PM10 Particulate (ug/m3)", "2018-02-01 00:00,9")
    out = L.read_station_files(spark, str(tmp_path), AIR)
    found = sorted((r.station, str(r.ts), r.pm25, r.pm10, r.o3) for r in out.collect())
    assert found == [
        ("BL0", "2018-01-01 00:00:00", 10.5, 20.5, None),
        ("BL0", "2018-01-01 01:00:00", 11.5, None, None),
        ("BL0", "2018-02-01 00:00:00", None, 9.0, None),
        ("CD1", "2018-01-01 00:00:00", 3.5, None, None),
    ]


def test_city_feed_by_position(spark, tmp_path):
    text(tmp_path / "feed.csv", "id,a,b,c,d,e,f,g,h", "1,x,2018-01-01 00:00:00,1,2,3,4,5,6", "2,x,2018-01-01 02:00:00,NaT,2,3,4,5,6")
    out = L.read_city_feed(spark, str(tmp_path / "feed.csv"), AIR)
    assert [(r.pm25, r.pm10, r.o3) for r in out.orderBy("ts").collect()] == [(1.0, 2.0, 5.0), (None, 2.0, 5.0)]


def test_history_from_sources(panel):
    a = panel([("s", "2017-01-01 23:00:00", 1.0), ("s", "2017-01-02 00:00:00", 2.0)])
    b = panel([("s", "2017-01-02 00:00:00", 9.0), ("s", "2017-01-02 02:00:00", 4.0)])
    out = H.build_history([a, b.withColumn("extra", F.lit(1))], ONE, start=fixed.HISTORY_START)
    assert [r.m1 for r in out.orderBy("ts").collect()] == [2.0, None, 4.0]


def test_order_decides_between_rows_of_a_source(panel):
    twice = panel([("s", "2018-01-01 00:00:00", 5.0, 1.0), ("s", "2018-01-01 00:00:00", None, 2.0)], ("m1", "seq"))
    for keep, expected in (("first", 5.0), ("last", None)):
        assert [r.m1 for r in H.build_history([twice], ONE, keep=keep, order=["seq"]).collect()] == [expected]
    with pytest.raises(Exception, match="does not decide"):
        H.build_history([twice], ONE).collect()


def test_station_files_with_quoted_headers(spark, tmp_path):
    spec = PanelSpec(measures=("pm25", "pm10"))
    head = ('MeasurementDateGMT', '"Upper St, North: PM2.5 Particulate (ug/m3)"', '"Upper St, North: PM10 Particulate (ug/m3)"')
    text(tmp_path / "UN1_2018-04.csv", ",".join(head), "2018-04-01 00:00,5.0,7.0", "2018-04-01 01:00,,8.0")
    text(tmp_path / "UN2_2018-04.csv", ",".join([head[2], head[0]]), "9.0,2018-04-01 00:00", "9.0,2018-04-01 00:00", "3.0,2018-04-01 00:00")
    headers = {"MeasurementDateGMT": "utc_time", "PM2.5 Particulate (ug/m3)": "pm25", "PM10 Particulate (ug/m3)": "pm10"}
    out = L.read_station_files(spark, str(tmp_path / "*.csv"), spec, headers=headers, names={})
    assert sorted((r.station, r.ts.hour, r.pm25, r.pm10) for r in out.collect()) == [
        ("UN1", 0, 5.0, 7.0), ("UN1", 1, None, 8.0), ("UN2", 0, None, 3.0)
    ]


def test_station_files_are_read_once(spark, tmp_path):
    """The files may change after the call: its result rests on what was read then."""
    head = "MeasurementDateGMT,A: PM10 Particulate (ug/m3)"
    text(tmp_path / "A1_x.csv", "", head, *[f"2018-04-01 {h:02d}:00,{h}" for h in range(24)], "not a time,5")
    text(tmp_path / "A2_x.csv", "MeasurementDateGMT,B: Nothing,B: PM10 Particulate (ug/m3),B: PM10 Particulate (ug/m3)", "2018-04-01 00:00,1,2,3", "2018-04-01 01:00")
    text(tmp_path / "A3_x.csv", "When,A: PM10 Particulate (ug/m3)", "2018-04-01 00:00,9")
    out = L.read_station_files(spark, str(tmp_path / "*.csv"), AIR)
    for name in ("A1_x.csv", "A2_x.csv", "A3_x.csv"):
        (tmp_path / name).write_text("gone")
    found = {(r.station, r.ts.hour): r.pm10 for r in out.collect()}
    assert found == {**{("A1", h): float(h) for h in range(24)}, ("A2", 0): 2.0, ("A2", 1): None}
    with pytest.raises(ValueError, match="no file has a column"):
        L.read_station_files(spark, str(tmp_path / "*.csv"), AIR)


def test_city_history_takes_fresh_rows(spark, panel, tmp_path):
    stored = panel([("a", "2018-01-01 00:00:00", 1.0), ("a", "2018-01-01 01:00:00", 2.0), ("z", "2018-01-01 00:00:00", 3.0)])
    K.write_panel(stored.withColumn("city", F.lit("london")), str(tmp_path), ONE)
    fresh = spark.createDataFrame(
        [("a", "2018-01-01 01:00:00", "5", 1), ("a", "2018-01-01 01:00:00", "7", 2), ("a", "NaT", "8", 1), ("a", "2018-01-01 02:00:00", "NaN", 1)],
        "station string, ts string, m1 string, seq int",
    )
    fresh = fresh.withColumns({"ts": F.try_to_timestamp("ts").cast("timestamp_ntz"), "m1": F.col("m1").try_cast("double")})
    out = L.read_city_history(spark, str(tmp_path), "london", ONE, fresh, stations=["a"], order=["seq"])
    assert sorted((r.station, r.ts.hour, r.m1) for r in out.collect()) == [("a", 0, 1.0), ("a", 1, 7.0), ("a", 2, None)]
    filled = L.read_city_history(spark, str(tmp_path), "london", ONE, fresh, stations=["a"], order=["seq"], fill=lambda d: d.fillna(0.0, ["m1"]))
    assert filled.where("m1 IS NULL").isEmpty()


def test_forward_fill_never_looks_ahead(spark, panel, tmp_path):
    """An hour that lands late is filled from earlier hours, whatever a former batch knew of later ones."""
    for i, rows in enumerate([[("s", "2024-01-01 05:00:00", 7.0), ("s", "2024-01-01 01:00:00", 3.0)], [("s", "2024-01-01 02:00:00", None), ("s", "2024-01-01 06:00:00", None)]]):
        panel(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = J.landed_stream(spark, str(tmp_path / "in"), panel(rows).schema)
        out = J.run_to_table(J.forward_fill_stream(stream, ONE), str(tmp_path / "out"))
    assert sorted((r.ts.hour, r.m1) for r in out.collect()) == [(1, 3.0), (2, 3.0), (5, 7.0), (6, 7.0)]


def test_refresh_overwrites_the_overlap(panel):
    old = panel([("s", "2018-01-01 00:00:00", 1.0), ("s", "2018-01-01 01:00:00", 2.0)])
    new = panel([("s", "2018-01-01 01:00:00", 5.0), ("s", "2018-01-01 03:00:00", 6.0)])
    full = H.refresh(old, new, ONE, "2018-01-01 01:00:00", partial=True)
    assert [r.m1 for r in full.orderBy("ts").collect()] == [1.0, 5.0, None, 6.0]
    cut = H.refresh(old, new, ONE, "2018-01-01 01:00:00", "2018-01-01 02:00:00")
    assert [r.m1 for r in cut.orderBy("ts").collect()] == [1.0, 5.0]


def test_landing_twice_adds_nothing(spark, panel, tmp_path):
    rows = panel([("s", "2018-01-01 00:00:00", 1.0), ("s", "2018-01-02 05:00:00", 2.0)])
    path = str(tmp_path / "landed")
    for _ in range(2):
        K.land(rows, path, ONE.keys, complete_before="2018-01-02")
    assert spark.read.parquet(path).count() == 1
    K.land(rows, path, ONE.keys)
    assert spark.read.parquet(path).count() == 2


def test_city_history(spark, panel, tmp_path):
    df = panel([("a", "2018-01-01 00:00:00", 1.0), ("b", "2018-01-01 00:00:00", 2.0)])
    K.write_panel(df.withColumn("city", F.when(df.station == "a", "beijing").otherwise("london")), str(tmp_path), ONE)
    assert [r.m1 for r in L.read_city_history(spark, str(tmp_path), "london", ONE).collect()] == [2.0]
    with pytest.raises(ValueError):
        L.read_city_history(spark, str(tmp_path), "paris", ONE)


def test_feature_cache_key(spark, tmp_path):
    built = []

    def build(value):
        def run():
            built.append(value)
            return spark.createDataFrame([(value,)], "v int")
        return run

    for value in (1, 1, 2):
        out = K.cached_features(spark, str(tmp_path), {"windows": [value]}, build(value))
        assert out.first().v == value
    assert built == [1, 2]


def test_scores_and_settings(spark, tmp_path):
    scores = spark.createDataFrame([("d2", 0.2), ("d1", 0.1)], "origin string, score double")
    for _ in range(2):
        K.append_scores(scores, str(tmp_path / "s"))
        K.append_settings(spark, str(tmp_path / "log"), [{"windows": [1]}], "s")
    assert [r.origin for r in K.read_scores(spark, str(tmp_path / "s")).collect()] == ["d1", "d2"]
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert K.read_if_any(spark, str(tmp_path / "nothing")) is None


def test_daily_job_writes_every_cell(spark, synthetic, tmp_path):
    spec = PanelSpec(measures=("m1", "m2"), absent={"m2": ("c",)})
    panels = {"x": synthetic.where("station <> 'c'"), "y": synthetic.where("station = 'c'")}
    settings = {
        "x": D.CitySetting([3, 5, 8], 0.5, lag_history_days=2, shifts=3, folds=2),
        "y": D.CitySetting([7, 14], 0.5, fill=None),
    }
    D.daily_job(panels, spec, "2024-02-20", settings, "medians", str(tmp_path))
    stored = spark.read.option("header", True).csv(str(tmp_path / "pred_date=2024-02-19/model=medians"))
    assert stored.count() == 3 * 48 and stored.where("double(m1) < 0 OR m1 IS NULL OR m2 IS NULL").count() == 0
    assert stored.where("test_id = 'a#47'").count() == 1
    curve = D.predict_cities({"x": panels["x"]}, spec, "2024-02-20", settings, "curve")
    pooled = D.predict_cities({"x": panels["x"]}, spec, "2024-02-20", settings, "pooled")
    assert curve.count() == pooled.count() == 2 * 48
    with pytest.raises(ValueError):
        D.predict_cities(panels, spec, "2024-02-20", settings, "guess")


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b
    if named:
        assert a.startswith(f"{named}/x-")


# --- streams -------------------------------------------------------------------------------------


def land_days(synthetic, path):
    days = synthetic.where("ts < '2024-01-09'").withColumn("day", F.col("ts").cast("date"))
    for d in sorted(r.day for r in days.select("day").distinct().collect()):
        days.where(F.col("day") == d).drop("day").coalesce(1).write.mode("append").parquet(path)


def test_streams_equal_batch(spark, synthetic, tmp_path):
    spec, source = PanelSpec(measures=("m1", "m2")), str(tmp_path / "source")
    holes = synthetic.withColumn("m1", F.when(F.pmod(F.hash("station", "ts"), F.lit(3)) > 0, F.col("m1")))
    land_days(holes, source)

    def stream():
        return J.landed_stream(spark, source, holes.schema, files_per_trigger=2)

    hourly = J.run_to_table(J.window_summary(stream(), "station", "ts", "m2", "1 day", delay="1 day"), str(tmp_path / "a"))
    batch = holes.where("ts < '2024-01-07'").groupBy("station", F.date_trunc("day", "ts")).agg(F.sum("m2").alias("t"))
    assert hourly.count() == batch.count() == 18
    assert sorted(round(r.total, 6) for r in hourly.collect()) == sorted(round(r.t, 6) for r in batch.collect())

    filled = J.run_to_table(J.forward_fill_stream(stream(), spec, "30 days"), str(tmp_path / "b"))
    by_day = fill_within(holes, spec, "day", direction="forward").where("ts < '2024-01-09'")
    assert filled.select(*spec.columns).exceptAll(by_day.select(*spec.columns)).count() == 0
    assert filled.count() == by_day.count()

    again = holes.where("ts < '2024-01-02'")
    again.write.mode("append").parquet(source)
    once = J.run_to_table(J.dedupe_stream(stream(), ["station", "ts"], "ts", "30 days"), str(tmp_path / "c"))
    assert once.count() == 8 * 24 * 3


def test_stream_resumes_and_upserts(spark, panel, tmp_path):
    source, table = str(tmp_path / "source"), str(tmp_path / "table")
    rows = panel([("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 2.0)])
    rows.write.parquet(source)
    stream = J.landed_stream(spark, source, rows.schema)
    assert J.run_upserts(stream, table, ONE.keys).count() == 2
    panel([("a", "2024-01-01 00:00:00", 0.5)]).write.mode("append").parquet(source)
    state = J.run_upserts(stream, table, ONE.keys)
    assert sorted((r.station, r.m1) for r in state.collect()) == [("a", 0.5), ("b", 2.0)]


def test_upsert_batches_are_merged(spark, panel, tmp_path):
    source, table = str(tmp_path / "source"), str(tmp_path / "table")
    for i in range(4):
        rows = panel([("a", "2024-01-01 00:00:00", float(i)), (f"b{i}", "2024-01-01 00:00:00", 2.0)])
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = J.landed_stream(spark, source, rows.schema)
        state = J.run_upserts(stream, table, ONE.keys, merge_after=2)
    expected = [("a", 3.0), *[(f"b{i}", 2.0) for i in range(4)]]
    assert sorted((r.station, r.m1) for r in state.collect()) == expected
    assert sorted(r.upto for r in spark.read.parquet(f"{table}/merges").collect()) == [1, 3]
    # a merge that broke off before its line in the log does not count
    panel([("x", "2024-01-01 00:00:00", 0.0)]).write.parquet(f"{table}/merged/upto=9")
    assert sorted((r.station, r.m1) for r in J.current_rows(spark, table, ONE.keys).collect()) == expected
    assert J.merge_batches(spark, table, ONE.keys) == 3
    scanned = J.current_rows(spark, table, ONE.keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "batch" in scanned and J.merge_batches(spark, str(tmp_path / "none"), ONE.keys) == -1


def test_forecasts_meet_their_readings(spark, panel, tmp_path):
    """Whichever side comes first, over several batches; two origins meet one reading twice."""
    made = spark.createDataFrame(
        [("2024-01-01", "a", 25, 1.0), ("2024-01-02", "a", 1, 3.0), ("2024-01-02", "a", 2, None), ("2024-01-02", "b", 0, 9.0)],
        "origin string, station string, horizon int, m1 double",
    ).withColumn("origin", F.col("origin").cast("date"))
    readings = [[("a", "2024-01-02 01:00:00", 2.0)], [("a", "2024-01-02 02:00:00", 4.0), ("a", "2024-01-02 05:00:00", 1.0)]]
    for i, rows in enumerate(readings):
        panel(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "truth"))
        made.where(f"day(origin) = {2 - i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "made"))
        ahead = J.landed_stream(spark, str(tmp_path / "made"), made.schema)
        truth = J.landed_stream(spark, str(tmp_path / "truth"), panel(rows).schema)
        out = J.run_to_table(J.forecasts_met(ahead, truth, ONE), str(tmp_path / "met"))
    found = sorted((str(r.origin), r.horizon, str(r.due), r["_a_m1"], r.m1) for r in out.collect())
    assert found == [
        ("2024-01-01", 25, "2024-01-02 01:00:00", 2.0, 1.0),
        ("2024-01-02", 1, "2024-01-02 01:00:00", 2.0, 3.0),
        ("2024-01-02", 2, "2024-01-02 02:00:00", 4.0, None),
    ]


def test_fixed_values():
    assert len(fixed.BEIJING_STATIONS) == 35 and len(fixed.LONDON_STATIONS) == 13
    assert len(fixed.HOLIDAYS) == 8
