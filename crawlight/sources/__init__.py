"""Readers for inventories, pages, robots files, sitemaps, fetches and sensor outputs."""
