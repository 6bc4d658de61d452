"""Spark-native analytics over catalogues of files and documents.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
holds rows on the driver: parameters (rule lists, query strings, thresholds)
are driver values, data never is.
"""

__version__ = "0.1.0"


class Refused(RuntimeError):
    """A question that cannot be answered honestly from the layers at hand."""
