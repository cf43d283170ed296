"""epiframe — entity-by-day panel analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from the
DataFrame API, so Catalyst plans it, pushes filters and prunes columns;
no operator triggers an action except the ones that must iterate (k-means)
or write (tables, streams, comments).
"""

from epiframe.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
