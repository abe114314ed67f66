"""Extraction and counts over streams of pages."""
