"""Part of the tempora analytics engine."""
