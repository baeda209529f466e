"""Readers and writers of session files and interchange formats."""
