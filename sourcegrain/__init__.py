"""A citation-evidence and corpus analytics engine on Spark DataFrames."""
