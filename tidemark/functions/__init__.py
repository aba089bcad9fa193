"""Column builders: text, keys, dates and the formula language."""
