"""DataFrame operators: row selection, joins, deduplication, statistics, quality."""
