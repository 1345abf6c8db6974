"""gneiss: tabular risk analytics as plain Spark DataFrame jobs."""
