"""Part of the meetpoint library."""
