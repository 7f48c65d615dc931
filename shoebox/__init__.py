"""shoebox: media-catalog analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns DataFrames. Thresholds, album ids,
seeds, clocks and key prefixes are always parameters.
"""

__version__ = "0.1.0"
