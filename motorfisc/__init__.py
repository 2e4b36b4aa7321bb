"""Vehicle-tax, catalogue-matching and corpus operators as Spark DataFrame jobs."""
