"""Hourly aggregates kept up to date by a stream."""
