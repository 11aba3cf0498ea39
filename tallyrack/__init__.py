"""Analytics of cluster jobs and their node samples, as Spark plans."""
