"""DataFrame operators. Column names are parameters, so they run on any table of the shape."""
