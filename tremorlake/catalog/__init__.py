"""Every operator as a named query over the given tables, with the same result in SQL.

Queries round floating sums and means, because two engines add in different orders, and give
time buckets as text.
"""

from . import (
    cleansing, expressions, filters, rollups, running, serving, sources, spread, statistics,
    streaming,
)
from .registry import ORACLES, QUERIES
