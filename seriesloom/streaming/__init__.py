"""Scoring a stream with stored parameters."""
