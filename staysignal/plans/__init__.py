"""Registered query plans (``catalog``) and their SQL oracles (``oracle``)."""
