"""Point-in-time market universes as Spark jobs.

Bars, instrument metadata and listing records go in as DataFrames; universe,
coverage and cost tables come out.  Nothing here runs on the driver except the
construction of logical plans.
"""

__version__ = "0.1.0"
