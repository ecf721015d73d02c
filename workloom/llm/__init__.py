"""Operators for preparing training text: filtering, duplicate removal, mixing, counting and archives."""
