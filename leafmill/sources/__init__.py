"""Scans, fixture adapters and table upkeep."""
