"""Operators on model tables: elements, references, formulas, graphs, common causes, event trees, substitutions."""
