"""Column builders; no function here runs a job."""
