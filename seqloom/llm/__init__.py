"""Operators of a large training-data pipeline: crawl records, scoring, dedup, mixing, tokenising."""
