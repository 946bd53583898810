from .clock import bucket, calendar, event_date, event_time, to_millis
from .keys import key_range, row_key
from .measures import (
    DEPTH_LONG, DEPTH_SHORT, MAP_SIZE, SCATTER_SIZE, TIMELINE_SIZE, alert_band, depth_class,
    display_size, megabytes, petajoules, place_tail, seismic_energy, severity_band,
)
from .regions import DOCUMENT6, FULL17, WAREHOUSE12, classify_region, region_sql
from .sql_functions import register_sql_functions
