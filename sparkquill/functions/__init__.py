"""Plain functions that run inside tasks."""
