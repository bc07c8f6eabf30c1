"""Requests over a published index, the summary archive, configuration and publication."""
