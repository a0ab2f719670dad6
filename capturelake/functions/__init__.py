"""Column expressions. Nothing in this package runs Python on the executors."""
