"""tessera: a knowledge-library and case-data engine built on Spark DataFrames."""
