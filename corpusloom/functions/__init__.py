"""Column functions: text folding, labels of signed years, markup as text."""
