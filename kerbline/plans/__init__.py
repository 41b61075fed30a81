"""Whole builds: from scans to rated, noded and ranked streets."""
