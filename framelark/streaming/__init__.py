"""Continuous forms of batch jobs that need no state."""
