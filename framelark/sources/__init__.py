"""Readers and writers: files to DataFrames and back."""
