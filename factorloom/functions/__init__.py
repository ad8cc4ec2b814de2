"""Factor expressions, Column functions and array kernels."""
