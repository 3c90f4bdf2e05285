"""Vocalmill: transcript analytics and training-data preparation on Spark DataFrames."""
