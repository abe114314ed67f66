"""Readers and writers: pages, tables, gold standards, knowledge bases."""
