"""The privacy, modelling and profiling operators."""
