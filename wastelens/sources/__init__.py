"""Readers, writers, dimension maintenance and driver-table views."""
