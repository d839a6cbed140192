"""Streams into the same rules: an addition of ours, as the reference has no streams."""
