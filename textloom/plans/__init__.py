"""Edits: plans of changes to texts, checked and applied."""
