"""Bounded row and pixel streams, and streams of newly arriving files."""
