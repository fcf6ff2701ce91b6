"""cinderwell — Spark-native event-study analytics for environmental readings.

Readings arrive long (one row per station, date and analyte), are pivoted wide,
matched to the event polygons that contain their station, placed on an
event-relative day axis, and summarised per event with paired statistics and
distributed models. Every operator is a ``DataFrame -> DataFrame`` function with
column names as parameters; the heavy lifting is Catalyst/Tungsten work.
"""

from cinderwell.session import get_session, checkpoint_dir, stable_checkpoint

__all__ = ["get_session", "checkpoint_dir", "stable_checkpoint"]
