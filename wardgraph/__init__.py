"""Clinical event graph, patient journeys and patient similarity on Spark DataFrames."""
