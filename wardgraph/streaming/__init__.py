"""Notes and facts that keep arriving."""
