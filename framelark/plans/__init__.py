"""Plans built from operators: corpora, loading, extraction, queries."""
