"""Expression text and types of the other dialect in Spark SQL."""
