"""Subpackage of veilspark."""
