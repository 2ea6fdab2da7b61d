"""Manifests, archives and their verification."""
