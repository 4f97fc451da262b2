"""textgauge: preparing and measuring text corpora with Spark DataFrames."""

__version__ = "0.1.0"
