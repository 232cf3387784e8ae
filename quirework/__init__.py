"""quirework: laid-out document analytics on Spark DataFrames."""
