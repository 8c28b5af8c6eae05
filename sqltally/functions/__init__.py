"""Column helpers and the skew-safe building blocks shared by the operators."""
