"""Every operator as a query on the supplied tables, next to the SQL it has to agree with."""
