import math

import pytest
from pyspark.sql import functions as F

from tremorlake import functions as fn
from tremorlake.functions.measures import SCATTER_SIZE

FULL = [
    ("12 km SW of Petrolia, California", "CALIFORNIA"),
    ("10 km N of Test Bay, CA", "CALIFORNIA"),
    ("Baja California, Mexico", "CALIFORNIA"),
    ("Southern Alaska", "ALASKA"),
    ("5 km E of Kodiak, AK", "ALASKA"),
    ("Hawaii Region", "HAWAII"),
    ("Volcano, HI", "HAWAII"),
    ("near the coast of Honshu, Japan", "JAPAN"),
    ("Papua, Indonesia", "INDONESIA"),
    ("Off the coast of Bio-Bio, Chile", "CHILE"),
    ("Mindanao, Philippines", "PHILIPPINES"),
    ("Oaxaca, Mexico", "MEXICO"),
    ("Raton, New Mexico", "MEXICO"),
    ("North Island of New Zealand", "NEW_ZEALAND"),
    ("Kermadec Islands region", "NEW_ZEALAND"),
    ("Puerto Rico region", "PUERTO_RICO"),
    ("Ponce, PR", "PUERTO_RICO"),
    ("western Turkey", "TURKEY"),
    ("Malatya, Türkiye", "TURKEY"),
    ("Kahramanmaras earthquake sequence", "TURKEY"),
    ("Pazarcik", "TURKEY"),
    ("south of Fiji", "SOUTH_PACIFIC"),
    ("Tonga Islands Region", "SOUTH_PACIFIC"),
    ("Vanuatu", "SOUTH_PACIFIC"),
    ("Loyalty Islands", "SOUTH_PACIFIC"),
    ("Papua New Guinea", "SOUTH_PACIFIC"),
    ("Solomon Islands", "SOUTH_PACIFIC"),
    ("Taiwan", "TAIWAN"),
    ("Iceland region", "ICELAND"),
    ("Crete, Greece", "MEDITERRANEAN"),
    ("central Italy", "MEDITERRANEAN"),
    ("South Sandwich Islands region", "SOUTH_ATLANTIC"),
    ("Jamaica", "CARIBBEAN"),
    ("Caribbean Sea", "CARIBBEAN"),
    ("Haiti region", "CARIBBEAN"),
    ("Caracas, Venezuela", "GLOBAL_OTHER"),
    ("Unknown Location in Ocean", "GLOBAL_OTHER"),
    ("", "GLOBAL_OTHER"),
    (None, "GLOBAL_OTHER"),
]
WAREHOUSE = [
    ("10 km N of Test Bay, CA", "GLOBAL_OTHER"),
    ("southern california", "CALIFORNIA"),
    ("Kermadec Islands region", "GLOBAL_OTHER"),
    ("Malatya, Türkiye", "TURKEY"),
    ("Vanuatu", "GLOBAL_OTHER"),
    ("Tonga", "SOUTH_PACIFIC"),
    (None, "GLOBAL_OTHER"),
]
DOCUMENT = [
    ("Hawaii, California", "HAWAII"),
    ("southern california", "GLOBAL_OTHER"),
    ("Baja California, Mexico", "CALIFORNIA"),
    ("Oaxaca, Mexico", "GLOBAL_OTHER"),
]


def column(spark, values, kind, *expressions):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [tuple(r) for r in df.select(*expressions).collect()]


@pytest.mark.parametrize("rules, cases", [
    (fn.FULL17, FULL), (fn.WAREHOUSE12, WAREHOUSE), (fn.DOCUMENT6, DOCUMENT),
])
def test_regions(spark, rules, cases):
    places = [p for p, _ in cases]
    found = column(
        spark, places, "string",
        fn.classify_region(F.col("v"), rules).alias("a"), fn.classify_region("v", rules).alias("b"),
    )
    for (place, expected), (by_column, by_sql) in zip(cases, found):
        assert (by_column, by_sql) == (expected, expected), place


def test_energy(spark):
    mags = [2.0, 4.0, 5.0, None, 250.0, -1.0]
    got = [r[0] for r in column(spark, mags, "double", fn.seismic_energy("v"))]
    assert got[0] == pytest.approx(10 ** 7.8, abs=1.0)
    assert got[2] / got[1] == pytest.approx(10 ** 1.5)
    assert got[3] == 0.0 and got[4] == 0.0  # unknown, and beyond a double
    assert got[5] == pytest.approx(10 ** 3.3)
    assert column(spark, ["bad", "3.0"], "string", fn.seismic_energy("v"))[0] == (0.0,)


def test_depth_boundaries(spark):
    depths = [34.999, 35.0, 150.0, 150.001, None, math.nan, -2.0]
    got = [r[0].split()[0] for r in column(spark, depths, "double", fn.depth_class("v"))]
    assert got == ["Shallow", "Intermediate", "Intermediate", "Deep", "Deep", "Deep", "Shallow"]
    long = column(spark, [1.0], "double", fn.depth_class("v", fn.DEPTH_LONG))
    assert long == [("Shallow (0-35 km) - High Crustal Risk",)]


def test_row_key_sorts_newest_first(spark):
    keys = [r[0] for r in column(
        spark, [1725692485000, 1725600000000, 1725690000000], "bigint",
        fn.row_key(F.lit("CALIFORNIA"), "v"),
    )]
    assert keys[0] == "CALIFORNIA#9223370311162290807"
    assert len(keys[0].split("#")[1]) == 19
    assert sorted(keys) == [keys[0], keys[2], keys[1]]
    assert fn.key_range("ALASKA") == ("ALASKA#", "ALASKA$")


def test_calendar(spark):
    # 2024-01-01 was a Monday, 2024-01-07 a Sunday.
    got = column(
        spark, [1704067200000, 1704668399999], "bigint",
        *fn.calendar(fn.event_time("v")),
        F.date_format(fn.bucket(fn.event_time("v"), "week"), "yyyy-MM-dd"),
        fn.event_date("v"),
    )
    assert got == [
        (0, "Monday", 0, "2024-01-01", "2024-01-01"), (6, "Sunday", 22, "2024-01-01", "2024-01-07"),
    ]
    with pytest.raises(ValueError):
        fn.bucket("v", "year")


def test_to_millis():
    assert fn.to_millis("2024-01-01") == 1704067200000
    assert fn.to_millis("2024-01-01T01:00:00+01:00") == 1704067200000
    assert fn.to_millis("2024-01-01 00:00:00.250") == 1704067200250
    assert fn.to_millis(5) == 5


def test_sizes_bands_tail(spark):
    sizes = [r[0] for r in column(spark, [4.0, 4.5, 6.0, 12.0], "double",
                                  fn.display_size("v", SCATTER_SIZE))]
    assert sizes == [18.0, 18.0, pytest.approx(18 * 1.5 ** 1.4), 260.0]
    assert not any(math.isnan(s) for s in sizes)
    bands = column(spark, [2.9, 3.0, 4.5, 6.0, None], "double", fn.severity_band("v"),
                   fn.alert_band("v"))
    assert bands == [("minor", None), ("moderate", None), ("strong", None), ("major", "6-7"),
                     (None, None)]
    tails = column(spark, ["a, b , c ", "alone", None], "string", fn.place_tail("v"))
    assert tails == [("c",), ("alone",), (None,)]


def test_sql_functions_match_columns(spark, quakes):
    fn.register_sql_functions(spark)
    by_sql = quakes.selectExpr(
        "classify_region(place) AS a", "seismic_energy(magnitude) AS b",
        "depth_class(depth_km) AS c", "seismic_row_key(region, epoch_millis) AS d",
    )
    by_column = quakes.select(
        fn.classify_region("place").alias("a"), fn.seismic_energy("magnitude").alias("b"),
        fn.depth_class("depth_km").alias("c"), fn.row_key("region", "epoch_millis").alias("d"),
    )
    assert by_sql.exceptAll(by_column).isEmpty() and by_column.exceptAll(by_sql).isEmpty()
