"""formproof: consistency checks for structured-plus-free-text records on Spark.

Every operator is a function from DataFrames (plus a small declared contract)
to a DataFrame.  Work that concerns one record stays inside that record's row
as built-in column expressions, so the same code runs in batch and on streams
and needs no shuffle.
"""
