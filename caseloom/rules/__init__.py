"""Rule tables: data the operators are given, never code paths of their own."""
