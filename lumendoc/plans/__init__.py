"""Plans of the remediation engine."""
