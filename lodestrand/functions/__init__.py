"""Column expressions, Arrow functions and NumPy kernels."""
