"""Column helpers: null rules, time arithmetic, label parsing, spherical geometry."""
