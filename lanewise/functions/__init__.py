"""Column builders: predicates, times, places, money and labels."""
