"""Functions of the remediation engine."""
