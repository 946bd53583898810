import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import feature, feature_frame, plan
from tremorlake import schemas
from tremorlake.operators import filters, rollups
from tremorlake.operators.cleansing import flatten
from tremorlake.operators.statistics import frequency_magnitude
from tremorlake.plans import cube
from tremorlake.plans.batch import run_batch
from tremorlake.session import workspace
from tremorlake.sources import clustered, compaction, footprint, parts, readers, writers


def test_landing_layout(spark, tmp_path):
    rows = feature_frame(spark, [feature("a"), feature("b")])
    for form in ("documents", "lines"):
        path = str(tmp_path / form)
        writers.land_features(rows, path, "2026-09-07 09:30:00", form)
        writers.land_features(rows, path, "2026-09-07 10:30:00", form)
        assert len(glob.glob(f"{path}/YYYY=2026/MM=09/DD=07/HH=09/*.json")) >= 1
        landed = readers.read_landed(spark, path, form)
        got = {tuple(r) for r in landed.select("id", *schemas.LANDING_KEYS).collect()}
        assert got == {(i, "2026", "09", "07", h) for i in "ab" for h in ("09", "10")}
        assert "PartitionFilters: [isnotnull(HH" in plan(landed.filter("HH = '09'"))


def test_documents_are_bounded(spark, tmp_path):
    """A document holds a bounded number of features and counts its own; whatever the session's
    Arrow batches, an ingestion that fits one document is one."""
    rows = spark.range(1050).select(
        F.concat(F.lit("q"), "id").alias("id"),
        F.lit(None).cast(schemas.PROPERTIES).alias("properties"),
        F.lit(None).cast(schemas.GEOMETRY).alias("geometry"),
    )
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 64)
    try:
        writers.land_features(rows, str(tmp_path / "d"), "2024-01-01", most=100)
        writers.land_features(rows, str(tmp_path / "one"), "2024-01-01")
    finally:
        spark.conf.set(setting, before)
    found = spark.read.schema(schemas.COLLECTION).option("multiLine", True).option(
        "recursiveFileLookup", True).json(str(tmp_path / "d"))
    counts = [tuple(r) for r in found.select("batch_count", F.size("features"), "metadata.count").collect()]
    assert sum(c for c, _, _ in counts) == 1050
    assert all(a == b == c <= 100 for a, b, c in counts)
    (one,) = readers.landed_documents(spark, str(tmp_path / "one")).collect()
    assert one.batch_count == 1050


def test_documents_keep_every_field(spark, tmp_path):
    """Null and empty structs, odd numbers and texts are in the documents as they came; a feature
    goes to Python as four packed columns, dealt by its id."""
    many = dict(felt=2**31 - 1, tsunami=-2**31, updated=-2**63, sig=0, nst=7, alert="", status="s",
                net="us", magType="m", type="t", title="T\n\"", cdi=0.1, mmi=1 / 3, dmin=5e-324, gap=-0.0)
    empty = tuple([None] * len(schemas.PROPERTIES))
    rows = feature_frame(spark, [
        feature("a", mag=1e300, time=2**63 - 1, place="ü \U0001f30b", **many), feature(None), feature("", mag=None),
        feature("n", mag=float("nan"), rms=float("inf")), feature("g", point=None),
        ("p", None, ("Point", [1.0, None, -2.5])), ("q", empty, (None, None)), ("r", None, ("", [])),
    ])
    for most in (3, 10_000):
        made = writers.bundle(rows, most)
        back = made.select(F.explode("features").alias("f")).select("f.*")
        assert back.schema == rows.schema
        assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    text = plan(writers.bundle(rows))
    assert "hashpartitioning(id" in text and "RoundRobin" not in text
    assert "MapInArrow documents(texts#" in text


def test_ids_are_those_of_the_format(spark):
    from tremorlake.sources import events_view

    ids = spark.sql("SELECT * FROM VALUES (0L), (7L), (99999999L), (100000000L), (-1L), (null), "
                    "(9223372036854775807L), (-9223372036854775808L) AS t(event_id)")
    both = ids.selectExpr(f"{events_view._ID} AS a", "format_string('q%08d', event_id) AS b")
    assert both.filter("NOT a <=> b").isEmpty()


def test_landing_evaluates_its_input_once(spark, tmp_path):
    """Ids that differ on every evaluation: the counts are those of the rows written."""
    rows = spark.range(3000).where(F.rand() < 0.5).select(
        F.uuid().alias("id"), F.lit(None).cast(schemas.PROPERTIES).alias("properties"),
        F.lit(None).cast(schemas.GEOMETRY).alias("geometry"))
    path = str(tmp_path / "d")
    writers.land_features(rows, path, "2024-01-01", most=400)
    counted = readers.landed_documents(spark, path).agg(F.sum("batch_count")).first()[0]
    assert counted == readers.read_landed(spark, path, "documents").count()


def test_processed_table_prunes(spark, quakes, tmp_path):
    for fmt in ("parquet", "orc"):
        path = str(tmp_path / fmt)
        writers.write_quakes(quakes, path, fmt)
        table = readers.read_quakes(spark, path, fmt)
        assert table.count() == quakes.count()
        window = readers.catalog_window(table, "2024-01-10", "2024-01-11", 3.0).select("event_id")
        text = plan(window)
        assert "PartitionFilters: [isnotnull(dt" in text
        assert "GreaterThanOrEqual(epoch_millis" in text and "GreaterThanOrEqual(magnitude,3.0)" in text
        assert "place" not in text.split("ReadSchema")[1].split("\n")[0]
        expected = quakes.filter(
            F.col("event_time").between("2024-01-10", "2024-01-11") & (F.col("magnitude") >= 3)
        )
        assert window.count() == expected.count() > 0


def test_overwrite_replaces_only_given_days(spark, quakes, tmp_path):
    path = str(tmp_path / "q")
    writers.write_quakes(quakes, path)
    one_day = quakes.filter("dt = '2024-01-03'")
    writers.write_quakes(one_day.limit(1), path)
    table = spark.read.schema(schemas.QUAKES).parquet(path)
    assert table.count() == quakes.count() - one_day.count() + 1


def test_batch_run_and_invariants(spark, features, quakes, tmp_path):
    """Rollups of one input agree on events, felt reports and energy."""
    root = str(tmp_path)
    run_batch(spark, features.unionByName(features), f"{root}/p", f"{root}/c", f"{root}/r", f"{root}/s")
    layout = {
        "hourly_activity": schemas.activity_schema("hour"),
        "daily_activity": schemas.activity_schema("day"),
        "monthly_activity": schemas.activity_schema("month"),
        "regional_summary": schemas.REGIONAL, "depth_summary": schemas.DEPTH,
        "diurnal_hourly_weekly": schemas.DIURNAL, "frequency_magnitude": schemas.FREQUENCY,
        "pager_tsunami_summary": schemas.PAGER,
    }
    tables = {n: readers.read_rollup(spark, f"{root}/r/{n}", layout[n]).toPandas() for n in layout}
    events = quakes.count()
    for name, table in tables.items():
        assert len(glob.glob(f"{root}/r/{name}/part-*.csv")) == 1
        for column in ("total_events", "event_count"):
            if column in table:
                assert table[column].sum() == events, name
    regional, pager = tables["regional_summary"], tables["pager_tsunami_summary"]
    assert regional.total_felt_reports.sum() == pager.total_felt.sum()
    assert regional.tsunami_warnings.sum() == pager[pager.tsunami_flag == 1].event_count.sum()
    energy = regional.cumulative_energy_joules.sum()
    for name in ("hourly_activity", "daily_activity", "monthly_activity", "diurnal_hourly_weekly"):
        assert abs(tables[name].total_energy_joules.sum() / energy - 1) < 1e-9
    processed = spark.read.schema(schemas.QUAKES).parquet(f"{root}/p")
    for column in ("event_id", "magnitude", "depth_km"):
        assert processed.filter(F.col(column).isNull()).isEmpty()
    assert spark.read.schema(schemas.SERVING).parquet(f"{root}/s").count() == events


def test_cube_gives_every_rollup(quakes):
    direct = {
        "hourly_activity": rollups.activity(quakes, "hour"),
        "daily_activity": rollups.activity(quakes, "day"),
        "monthly_activity": rollups.activity(quakes, "month"),
        "regional_summary": rollups.regional_scorecard(quakes),
        "depth_summary": rollups.depth_strata(quakes),
        "diurnal_hourly_weekly": rollups.diurnal(quakes),
        "frequency_magnitude": frequency_magnitude(quakes),
        "pager_tsunami_summary": rollups.pager(quakes),
    }
    reduced = cube.build(quakes)
    assert set(direct) == set(cube.ROLLUPS)
    for name, expected in direct.items():
        got = cube.ROLLUPS[name][0](reduced)
        assert got.columns == expected.columns, name
        key = lambda r: tuple(v for v in r if not isinstance(v, float))
        for a, b in zip(sorted(got.collect(), key=key), sorted(expected.collect(), key=key), strict=True):
            assert tuple(a) == pytest.approx(tuple(b)) if name == "frequency_magnitude" else all(
                x == y or x == pytest.approx(y) for x, y in zip(a, b)), name


def test_compaction_keeps_one_copy(spark, features, tmp_path):
    root = str(tmp_path)
    for hour in ("05", "06"):
        writers.land_features(features, f"{root}/l", f"2024-02-01 {hour}:00:00", "lines")
    writers.compact(spark, f"{root}/l", f"{root}/p", form="lines")
    compacted = spark.read.schema(schemas.QUAKES).parquet(f"{root}/p")
    assert compacted.exceptAll(flatten(features)).isEmpty()
    assert compacted.count() == features.count()


def test_footprint(spark, quakes, features, tmp_path):
    root = str(tmp_path)
    writers.land_features(features, f"{root}/raw", "2024-02-01")
    for fmt in ("parquet", "orc", "csv"):
        writers.write_quakes(quakes.coalesce(1), f"{root}/{fmt}", fmt)
    sizes = footprint.storage_footprint(spark, root)
    assert "length" in plan(sizes) and "content" not in plan(sizes)
    got = {r.format: r for r in sizes.collect()}
    assert set(got) == {"json", "parquet", "orc", "csv"}
    assert got["json"].savings_percent == 0.0
    assert all(0 < got[f].bytes < got["json"].bytes for f in ("parquet", "orc", "csv"))


def test_a_busy_day_is_split(spark, quakes, tmp_path):
    """Most rows are of one day: it is written by several tasks, quiet days are not."""
    skewed = quakes.select(
        "*", F.explode(F.sequence(F.lit(1), F.when(F.col("dt") == "2024-01-05", 900).otherwise(1)))
    ).drop("col").withColumn("place", F.concat_ws("-", "place", F.uuid()))
    skewed.repartition(8).write.parquet(str(tmp_path / "in"))
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "512k")
    try:
        writers.write_quakes(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "q"))
    finally:
        spark.conf.set(setting, before)
    assert len(glob.glob(f"{tmp_path}/q/dt=2024-01-05/*.parquet")) > 1
    assert len(glob.glob(f"{tmp_path}/q/dt=2024-01-06/*.parquet")) == 1


class _Session:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})


def test_no_machine_folder_on_a_cluster():
    assert workspace(_Session("local[2]"), "x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace(_Session("yarn"), "x")


def test_workspace_is_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert workspace(spark, "x").startswith(named.rstrip("/"))
    assert workspace(spark, "x") != workspace(spark, "x")


def test_only_new_hours_are_folded(spark, features, quakes, tmp_path):
    """The second run opens the new hour only; late hours merge by ``updated``; an event whose time
    was revised moves to its new day; a run without new hours does nothing."""
    landed, path = str(tmp_path / "landed"), str(tmp_path / "days")
    props = F.col("properties")
    writers.land_features(features, landed, "2024-02-01 06:00:00", "lines")
    assert compaction.fold(spark, landed, path) == ["2024/02/01/06"]
    day = F.lit(86_400_000).cast("bigint")
    one = F.col("id") == features.select(F.min("id")).first()[0]
    moved = features.filter(one).withColumn("properties", props.withField(
        "time", props["time"] + day).withField("updated", props["updated"] + day))
    writers.land_features(moved, landed, "2024-02-01 07:00:00", "lines")
    old = features.withColumn("properties", props.withField("updated", props["updated"] - 1)
                              .withField("mag", F.lit(9.9)))
    writers.land_features(old, landed, "2024-02-01 05:00:00", "lines")
    assert compaction.new_hours(spark, landed, path, until="2024/02/01/06") == ["2024/02/01/05"]
    hours = compaction.new_hours(spark, landed, path)
    text = plan(compaction.landed_in(spark, landed, ["2024/02/01/07"]))
    assert "concat_ws" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert compaction.landed_in(spark, landed, ["2024/02/01/07"]).count() == 1
    before = parts.manifest(spark, f"{path}/days")
    assert hours == ["2024/02/01/05", "2024/02/01/07"]
    assert compaction.fold(spark, landed, path, until="2024/02/01/06") == hours[:1]
    assert compaction.fold(spark, landed, path) == hours[1:]
    assert compaction.fold(spark, landed, path) == []
    after = parts.manifest(spark, f"{path}/days")
    table = compaction.compacted(spark, path)
    assert table.count() == features.count() and table.filter("magnitude = 9.9").isEmpty()
    assert table.select("event_id").distinct().count() == features.count()
    change = table.join(quakes.select("event_id", F.col("dt").alias("was")), "event_id").filter(
        "dt <> was")
    assert change.count() == 1
    assert set(after.totals["hours"]) == {"2024/02/01/05", "2024/02/01/06", "2024/02/01/07"}
    assert len(before.slots) <= len(after.slots) <= len(before.slots) + 1


def _row_groups(path, least, depth):
    """All row groups below ``path`` and those whose statistics admit the selection."""
    total = opened = 0
    for file in path.rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            mag, deep = (meta.row_group(g).column(at[c]).statistics
                         for c in ("magnitude", "depth_km"))
            total += 1
            opened += mag.max >= least and deep.max >= depth[0] and deep.min <= depth[1]
    return total, opened


def test_curve_order_skips_most_row_groups(spark, tmp_path):
    n = 40_000
    table = tmp_path / "table"
    # Magnitudes fall off as in the law, one depth holds a third of all rows.
    spark.range(n).select(
        F.col("id").cast("string").alias("event_id"),
        (2.5 - F.log(F.rand(3))).alias("magnitude"),
        F.when(F.col("id") % 3 == 0, 10.0).otherwise(F.rand(4) * 700).alias("depth_km"),
        (F.rand(5) * 1e9).cast("bigint").alias("epoch_millis"),
    ).write.parquet(str(table))
    rows = spark.read.parquet(str(table))
    out = tmp_path / "clustered"
    clustered.write_clustered(rows, str(out), files=128)
    found = filters.slice_quakes(spark.read.parquet(str(out)), 4.5, (70, 300))
    assert sorted(found.collect()) == sorted(filters.slice_quakes(rows, 4.5, (70, 300)).collect())
    assert spark.read.parquet(str(out)).count() == n
    total, opened = _row_groups(out, 4.5, (70, 300))
    assert total >= 100 and opened <= total / 4
    assert "PushedFilters: [IsNotNull(magnitude), IsNotNull(depth_km)" in plan(found)


def test_curve_order_of_nothing_and_of_nulls(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", None, 5.0, 1), ("b", 3.0, None, None), ("c", 3.0, 5.0, 2), ("c", 3.0, 5.0, 2)],
        "event_id string, magnitude double, depth_km double, epoch_millis bigint")
    for name, frame in (("some", rows), ("none", rows.limit(0))):
        clustered.write_clustered(frame, str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        assert got.columns == rows.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, frame.collect()))
