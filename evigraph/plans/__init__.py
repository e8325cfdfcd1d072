"""Compositions: the service over one graph, and the registered queries."""
