"""Streams: the frames of a container that is still being written, and containers that arrive in a folder."""
