"""Operators over pages, robots files, sitemaps, entities, facts and findings."""
