"""Column functions: text units, page lists, pointers, masks, policies.  Built-in expressions only."""
