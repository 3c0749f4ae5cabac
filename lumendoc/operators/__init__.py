"""Operators of the remediation engine."""
