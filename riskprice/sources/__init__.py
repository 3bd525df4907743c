"""Inputs (test tables, files, samples) and sinks."""
