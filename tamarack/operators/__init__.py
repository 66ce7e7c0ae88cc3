"""Tamarack operators."""
