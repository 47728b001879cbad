"""Learned and exact operators for preparing training text."""
