"""Column functions and the numeric kernels behind Arrow operators."""
