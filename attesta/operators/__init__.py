"""Relational, graph and grouped operators."""
