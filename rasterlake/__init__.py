"""Analytics over gridded Earth-observation data and training corpora, built on Spark DataFrames."""
