"""Calendars, and helpers beside the words."""
