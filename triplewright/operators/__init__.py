"""Graph operators, DataFrame to DataFrame."""
