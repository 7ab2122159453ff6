"""Leafwright: document text preparation and quality checks as Spark plans."""
