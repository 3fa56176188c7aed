"""A PySpark engine for probabilistic risk models."""
