"""Column expressions: file names, times, text cleaning, predicates."""
