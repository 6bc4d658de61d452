"""Whole jobs put together from operators: the commands a user runs."""
