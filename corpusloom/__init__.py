"""Corpusloom: analytics over corpora of annotated records, as Spark DataFrames."""
