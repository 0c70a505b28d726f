"""Scalar and vector expressions."""
