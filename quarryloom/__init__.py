"""Site-structure and knowledge-base jobs on Spark."""
