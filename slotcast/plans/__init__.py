"""Whole computations over tables, put together from the operators."""
