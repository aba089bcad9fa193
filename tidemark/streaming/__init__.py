"""Streaming versions of the batch operators, an extension."""
