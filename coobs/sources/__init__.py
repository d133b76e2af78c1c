"""Readers and writers with the checks that belong to them."""
