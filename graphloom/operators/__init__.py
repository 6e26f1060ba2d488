"""DataFrame operators: joins, graph loops, hierarchies, references, nested data, rules."""
