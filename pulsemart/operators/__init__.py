"""Reusable DataFrame operators that need more than one built-in step."""
