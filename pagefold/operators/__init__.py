"""DataFrame operators: planning, merging, validation, diffing, attempts, jobs, metrics."""
