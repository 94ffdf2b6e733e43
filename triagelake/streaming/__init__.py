"""Operators over streams of rows that arrive about in time order."""
