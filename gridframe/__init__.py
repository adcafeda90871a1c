"""gridframe: schedule-grid recovery and corpus preparation on Spark DataFrames."""
