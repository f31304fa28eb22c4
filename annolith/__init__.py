"""Analytics over annotated-image datasets and model predictions, on Spark DataFrames."""
