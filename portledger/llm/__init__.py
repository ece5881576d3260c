"""Operators for preparing training text: each is a module here, its query is in ``queries``."""
