"""Part of rosterloom."""
