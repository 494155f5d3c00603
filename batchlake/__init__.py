"""batchlake: sample sets, batch plans, sequence layouts and text encoding as Spark DataFrame plans."""
