"""Part of platter; see README.md."""
