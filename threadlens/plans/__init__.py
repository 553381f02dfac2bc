"""Stages that chain the operators, and the catalogue of registered queries."""
