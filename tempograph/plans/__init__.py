"""Table bindings and the registered queries."""
