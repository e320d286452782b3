"""quaymark: analytics over library-style collections, written as Spark DataFrame jobs."""
