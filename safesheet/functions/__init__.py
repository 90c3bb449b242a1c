"""Part of safesheet."""
