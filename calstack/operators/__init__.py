"""Column kernels: elementwise, row-wise, window and resampling expressions."""
