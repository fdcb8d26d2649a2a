"""Operators for preparing training data; one module each, the registered queries in ``queries``."""
