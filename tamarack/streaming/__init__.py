"""Tamarack streaming."""
