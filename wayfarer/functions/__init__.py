"""Part of the trajectory library."""
