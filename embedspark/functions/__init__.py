"""Column functions: no function here triggers a job or a shuffle."""
