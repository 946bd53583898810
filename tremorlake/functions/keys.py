"""The newest-first row key of the serving table."""

from pyspark.sql import functions as F

# Key layout REGION#<19 digits of (largest 64-bit integer - milliseconds)>.
LAST_MILLI = 9223372036854775807
SEPARATOR = "#"
STOP = "$"  # the character after the separator: first key beyond a region


def row_key(region, epoch_millis):
    region = F.col(region) if isinstance(region, str) else region
    millis = F.col(epoch_millis) if isinstance(epoch_millis, str) else epoch_millis
    return F.format_string(f"%s{SEPARATOR}%019d", region, F.lit(LAST_MILLI) - millis)


def key_range(region):
    """First key of a region and first key after it."""
    return f"{region}{SEPARATOR}", f"{region}{STOP}"
