"""Column helpers and label algebra."""
