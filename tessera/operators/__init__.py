"""Operators on intervals, events and copy numbers."""
