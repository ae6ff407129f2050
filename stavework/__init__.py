"""stavework: analytics over ordered symbolic events, as Spark DataFrame operators."""
