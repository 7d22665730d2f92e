"""Operators put together: cleaning, refreshing and reporting."""
