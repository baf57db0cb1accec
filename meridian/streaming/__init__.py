"""Meridian streaming."""
