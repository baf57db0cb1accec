"""Meridian operators."""
