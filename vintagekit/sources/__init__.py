"""Readers: each turns one kind of published file into rows."""
