"""Recurring imports."""
