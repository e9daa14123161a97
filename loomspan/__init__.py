"""Spark-native engine for annotated lists, closed intervals, expression matrices and signal tracks.

Everything is a pure ``DataFrame -> DataFrame`` function; nothing mutates its input and nothing
holds data on the driver unless the docstring states the bound.
"""

__version__ = "0.1.0"
