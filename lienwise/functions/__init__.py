"""Part of lienwise."""
