"""File formats: Python data sources plus readers and writers over built-in formats."""
