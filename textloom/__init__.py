"""A Spark-native text analytics engine: sources, functions, operators, plans and streaming over DataFrames."""
