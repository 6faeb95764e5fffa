"""Marts: each is a function from source frames to one frame, for all partners, zones or stores at once."""
