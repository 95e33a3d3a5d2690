"""keyloom: ordered typed keys, lazy sequences and mutation logs on Spark DataFrames."""

__version__ = "0.1.0"
