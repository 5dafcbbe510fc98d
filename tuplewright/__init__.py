"""A logic-query and data-processing engine on Spark DataFrames."""
