"""Meridian sources."""
