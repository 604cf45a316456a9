"""Operators for preparing training corpora; nothing else in keyfold imports this subpackage."""
