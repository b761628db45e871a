"""Readers, writers and the table views used as query inputs."""
