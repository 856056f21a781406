"""anchorloom: contextual linking, catalog analytics and corpus hygiene on Spark.

Every operator takes DataFrames and returns DataFrames; nothing in the core
collects an unbounded result to the driver.
"""
