"""Readers and writers: files, databases, services and project folders."""
