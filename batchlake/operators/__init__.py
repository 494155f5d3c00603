"""Row access, batches, sequence layouts, sampling and aggregates over DataFrames."""
