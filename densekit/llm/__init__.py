"""Operators for the data of language-model training; nothing else in the library imports them."""
