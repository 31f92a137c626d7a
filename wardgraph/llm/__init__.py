"""Operators for preparing training text: mixing, extraction, quality, duplicates, formatting, scans."""
