"""Part of terrane."""
