"""Column-expression helpers: predicates, exact rounding, keyword topics, dates."""
