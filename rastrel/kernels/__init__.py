"""NumPy kernels that run in Python workers, one image, arc or document at a time; none needs Spark."""
