"""Graph operators over `nodes` and `edges` tables."""
