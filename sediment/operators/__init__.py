"""Table and query operators; every function takes and returns DataFrames."""
