"""Driver-side plans that chain Spark jobs: mitigation, enhancement, the run loop."""
