"""Column functions: names, text, bits, unsigned numbers, enums, comparison."""
