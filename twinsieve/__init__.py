"""Part of the twinsieve engine."""
