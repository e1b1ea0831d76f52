"""goldsieve: build and grade reasoning datasets with Spark.

Every operator takes and returns DataFrames, so they chain with
``DataFrame.transform``.  The model itself stays outside: prompts go out as a
table and completions come back as a table.
"""
