"""Report tables and the bindings of the given tables to the operators."""
