"""Operators for preparing large text and entity corpora; nothing outside this folder imports them."""
