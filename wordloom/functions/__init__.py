"""Part of the wordloom engine."""
