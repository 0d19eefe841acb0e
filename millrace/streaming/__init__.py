"""Views kept up to date by Structured Streaming."""
