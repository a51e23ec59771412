"""Column helpers and NumPy kernels."""
