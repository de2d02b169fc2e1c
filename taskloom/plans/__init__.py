"""End-to-end jobs, derived fixtures and the query catalogue."""
