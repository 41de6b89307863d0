"""Composed entry points and the registered fixture queries."""
