"""tapeflow — retail-versus-institutional order-flow analytics on Spark.

Every operator is a pure function from DataFrames (or Columns) to
DataFrames (or Columns).  Nothing loops over tickers on the driver:
per-ticker work is ``groupBy``/``Window.partitionBy`` on a ``ticker``
column of one long table per kind (snapshot, daily flow, intraday flow,
index flow).
"""

__version__ = "0.1.0"
