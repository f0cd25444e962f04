"""Column expressions shared by the operators; no function here runs a job."""
