"""Sources: blob paths, paged listings and source classification."""
