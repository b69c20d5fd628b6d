"""auditspark: audit of agent source code as Spark DataFrame jobs."""
