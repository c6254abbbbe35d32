"""jobmeter: usage analytics over batch-scheduler job history, written as Spark DataFrame operators."""
