"""newsloom: a PySpark-native engine that turns crawled news pages into structured rows.

Everything is a function from DataFrames to DataFrames.  URL, text and time rules are Catalyst
column expressions; clustering, scoring, de-duplication and boundary finding are group-bys,
joins and windows; Arrow-batched Python is used only where Spark has no operator (HTML
tokenising, multi-charset decoding, free-form dates).
"""

__version__ = "0.1.0"
