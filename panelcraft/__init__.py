"""panelcraft: panel analytics on Spark DataFrames.

Turns irregular business records (interval payments, dated filings,
registers) into one row per entity and quarter and takes the panel through
encoding, scaling, binning, splitting, MLlib training and evaluation.
"""

__version__ = "0.1.0"
