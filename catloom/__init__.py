"""Catalog integration as Spark jobs: clean, link, merge, enrich, audit and publish product records."""
