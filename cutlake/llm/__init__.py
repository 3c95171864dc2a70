"""Operators that turn take transcripts and other texts into training data."""
