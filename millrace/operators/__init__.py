"""Incremental maintenance: what a change affects, and how a stored view takes it up."""
