"""workboard package."""
