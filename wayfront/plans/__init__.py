"""Kernels, pipelines and the catalog of queries."""
