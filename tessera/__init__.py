"""Spark-first analytics over temporal, provenance-tracked document graphs.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame.  The subpackage ``llm`` holds the operators for training text; the
rest of the library never imports it.
"""

__version__ = "0.1.0"
