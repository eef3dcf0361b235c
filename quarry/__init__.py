"""Record linkage, search analytics and corpus preparation as Spark DataFrame operators."""
