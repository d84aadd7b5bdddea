"""pagelake: scan preparation and page compaction expressed as Spark jobs."""

__version__ = "0.1.0"
