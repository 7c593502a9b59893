"""Column -> Column building blocks; no function here triggers a job."""
