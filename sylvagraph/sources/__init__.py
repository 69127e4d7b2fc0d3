"""Sources: relational graph views and front ends."""
