"""Column functions over paths and bytes."""
