"""PySpark-native analytics over listings, postings, documents and messages.

Every operator takes and returns DataFrames (or Columns); vocabularies and rules
are tables or parameters, and nothing reads the clock.
"""
