"""Operators over tables of files."""
