"""Streaming of the remediation engine."""
