"""Column-level helpers. Nothing in this package triggers a job."""
