"""Search, judge and maintain messy sale listings in bulk with Spark DataFrames."""
