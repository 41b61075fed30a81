"""Column builders: text, rules, geometry."""
