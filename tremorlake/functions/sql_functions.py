"""The scalar expressions as SQL functions for ``spark.sql`` users."""

from .keys import LAST_MILLI, SEPARATOR
from .measures import DEPTH_LONG, depth_sql, energy_sql
from .regions import DOCUMENT6, FULL17, WAREHOUSE12, region_sql


def definitions():
    return {
        "classify_region(place STRING) RETURNS STRING": region_sql("place", FULL17),
        "classify_region_warehouse(place STRING) RETURNS STRING": region_sql("place", WAREHOUSE12),
        "classify_region_document(place STRING) RETURNS STRING": region_sql("place", DOCUMENT6),
        "seismic_energy(m DOUBLE) RETURNS DOUBLE": energy_sql("m"),
        "depth_class(d DOUBLE) RETURNS STRING": depth_sql("d"),
        "depth_class_long(d DOUBLE) RETURNS STRING": depth_sql("d", DEPTH_LONG),
        "seismic_row_key(region STRING, ms BIGINT) RETURNS STRING":
            f"format_string('%s{SEPARATOR}%019d', region, {LAST_MILLI}L - ms)",
    }


def register_sql_functions(spark):
    """Create the functions in this session; they inline into the calling plan."""
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return spark
