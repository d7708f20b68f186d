"""Array kernels behind the operators that expressions can not state. They know nothing of Spark."""
