"""Column-level helpers: cleaning text-typed values, rounding, predicates."""
