"""threadloom: concept-graph retrieval and data-processing operators on Spark DataFrames."""
