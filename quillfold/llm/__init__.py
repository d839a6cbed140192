"""Training-data operators: ten Spark jobs over document and conversation tables.

Nothing outside this package imports it.  Every operator takes DataFrames and returns
DataFrames; the thin contract queries live in :mod:`quillfold.llm.queries`.
"""
