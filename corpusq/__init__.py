"""corpusq: corpus building, retrieval and evidence checking as Spark DataFrame operators."""
