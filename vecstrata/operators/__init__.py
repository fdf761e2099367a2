"""Graph operators: building, walking, inserting, reachability."""
