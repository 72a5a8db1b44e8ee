"""Training-data pipeline operators: each module is one DataFrame-in, DataFrame-out operator."""
