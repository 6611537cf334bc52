"""Operators over tables of lines, links, HTML facts, chunks and findings."""
