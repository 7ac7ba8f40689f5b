"""Column expressions: dates, ids, band names, radar algebra."""
