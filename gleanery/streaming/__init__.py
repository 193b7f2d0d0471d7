"""Pushed changes as a stream."""
