"""Part of foliospark; see README.md."""
