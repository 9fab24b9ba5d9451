"""Property-graph retrieval and text-context assembly as Spark DataFrame plans."""
