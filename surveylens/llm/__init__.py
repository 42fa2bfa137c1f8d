"""Training-data operators: packing, PII, tokenising, deduplication, HTML
extraction, secret scans, quality rules and classifier, language ID.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their DuckDB SQL.
"""
