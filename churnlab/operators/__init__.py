"""DataFrame operators: filters, profiles, aggregates, windows, joins."""
