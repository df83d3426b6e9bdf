"""Config-driven pipelines over the operators, run tables and whole-pipeline jobs."""
