"""Sources: each gives a DataFrame of raw documents."""
