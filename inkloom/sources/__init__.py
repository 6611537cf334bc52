"""Readers and writers: text, archives, HTML pages, sidecar files and the derived fixtures."""
