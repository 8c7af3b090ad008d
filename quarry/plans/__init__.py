"""Whole workloads composed of operators, and the registered queries."""
