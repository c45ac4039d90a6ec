"""Token statistics over collections of documents, as Spark DataFrame operators."""
