"""waymark: place retrieval and geodesy queries as Spark DataFrame plans."""
