"""Indoor navigation and campus data as Spark DataFrame operators."""
