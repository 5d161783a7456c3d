"""Readers of decks and scripts, and adapters that shape plain tables as decks."""
