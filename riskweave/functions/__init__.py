"""Scalar functions: numeric, Boolean, lifetime laws, random deviates, interval domains."""
