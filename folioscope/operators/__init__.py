"""Operators on tables of pages, attempts and boxes."""
