"""tabsmith: tabular preparation and regression modelling as Spark jobs."""

__version__ = "0.1.0"
