"""Programs over the lake's tables as functions of DataFrames."""
