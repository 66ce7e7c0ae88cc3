"""Tamarack functions."""
