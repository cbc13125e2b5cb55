"""loomstone: an event-sourced knowledge engine on Spark DataFrames."""
