"""Set-oriented operators; every function takes and returns DataFrames."""
