"""Panel plans: one function for each visualization."""
