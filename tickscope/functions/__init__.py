"""Column expressions for names, prices, wear, scoring and audit."""
