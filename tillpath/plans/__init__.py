"""Whole jobs: preparing the stored tables, and channel reports straight from raw events."""
