"""Scans, validation, sinks, generators and default fills."""
