"""Scans and sinks: market text files, panels, matrices and posterior draws."""
