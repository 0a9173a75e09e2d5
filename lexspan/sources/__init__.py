"""Readers, loaders, publishing and report rendering."""
