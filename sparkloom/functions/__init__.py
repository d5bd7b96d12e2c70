"""Scalar functions: native column expressions, and parsers that run inside Arrow UDFs."""
