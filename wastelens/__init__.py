"""wastelens: waste and cost event-log analytics on Spark DataFrames.

Every public function takes and returns DataFrames (or Columns) and builds
a lazy plan; nothing reads the wall clock (``as_of`` is always an argument)
and nothing pulls data to the driver except small, size-bounded tables
(model trees, chunk boundaries), which are stated where they happen.
"""

__version__ = "0.1.0"
