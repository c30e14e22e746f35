"""Query languages: parsers and their compilation to DataFrames."""
