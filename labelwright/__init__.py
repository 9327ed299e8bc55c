"""Label curation for large item collections, written as Spark DataFrame operators."""
