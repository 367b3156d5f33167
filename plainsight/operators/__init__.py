"""DataFrame operators: projections, joins, aggregates, ranking, reshaping, nesting."""
