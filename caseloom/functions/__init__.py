"""Column expressions. Nothing here touches a DataFrame or runs Python per row."""
