"""Literature curation, retrieval and corpus engine on Spark DataFrames."""
