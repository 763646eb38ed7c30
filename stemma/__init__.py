"""Analytics over property graphs of source code, on DataFrames."""
