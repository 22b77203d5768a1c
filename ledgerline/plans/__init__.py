"""Ready-made queries. Functions take reference-shaped DataFrames; QUERIES binds them."""
