"""DataFrame operators: aggregation, matching, evolution, gates, ranking, scanners."""
