"""Readers and writers of the tables that the jobs use."""
