"""Native column expressions: cell parsing and slice predicates."""
