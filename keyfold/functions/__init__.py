"""Part of keyfold."""
