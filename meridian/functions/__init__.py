"""Meridian functions."""
