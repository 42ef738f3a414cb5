"""Column expressions on vectors, codes and bit strings."""
