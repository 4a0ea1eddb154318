"""Readers that turn files or raw rows into the tables the operators take, and the sinks."""
