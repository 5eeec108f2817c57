"""Security-policy, audit-log and file-label analytics on Spark DataFrames."""
