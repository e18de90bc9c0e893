"""Operators for preparing training text: deduplication, language, scoring, decontamination, mixing, rules."""
