"""Row operators: distances, matching, chance, coefficients and data-quality operators."""
