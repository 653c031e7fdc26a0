"""Readers and writers of volumes, atom files and pick lists."""
