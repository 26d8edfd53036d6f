"""Column and window helpers shared by the operators."""
