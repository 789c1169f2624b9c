"""Streams: the same analyses on unbounded inputs."""
