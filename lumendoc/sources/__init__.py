"""Sources of the remediation engine."""
