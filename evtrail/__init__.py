"""Evidence-backed event analytics over conversations, as Spark DataFrame operators."""
