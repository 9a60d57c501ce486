"""Byte-stream codecs: pure functions on bytes; sources and plans wrap them in Arrow functions."""
