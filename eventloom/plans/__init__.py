"""Reads of the store: single pages, many requests at once, whole page walks."""
