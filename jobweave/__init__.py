"""jobweave: matching candidate profiles to job postings as Spark jobs."""
