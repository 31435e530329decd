"""heddle: document items, change streams and queues on Spark DataFrames."""
