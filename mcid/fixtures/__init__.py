"""Input views derived from the benchmark tables, once per engine.

``spark_views`` builds them as DataFrames and ``sql_views`` holds the same rules
as SQL common table expressions, so both engines see identical rows. Everything
is integer arithmetic over whole tables; no view drops or samples rows.
"""

from .spark_views import Views
from .sql_views import with_views

__all__ = ["Views", "with_views"]
