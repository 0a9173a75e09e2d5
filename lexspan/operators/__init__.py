"""Corpus operators: lazy DataFrame -> DataFrame functions."""
