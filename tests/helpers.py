"""Small hand-made frames and plan text."""

from tremorlake.schemas import FEATURE, GEOMETRY, PROPERTIES, QUAKES


def feature(id, mag=3.5, time=1725690000000, updated=None, place="Test Bay, CA",
            point=(-122.0, 37.0, 10.0), **properties):
    values = {"mag": mag, "place": place, "time": time, "updated": updated, **properties}
    return (
        id,
        tuple(values.get(f.name) for f in PROPERTIES),
        None if point is None else ("Point", list(point)),
    )


def feature_frame(spark, rows):
    return spark.createDataFrame(rows, FEATURE)


def quake_frame(spark, rows):
    """Rows are dicts of the columns that matter; others are null."""
    names = QUAKES.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], QUAKES)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()
