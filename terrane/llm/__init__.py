"""Operators for training-data pipelines. Nothing else in terrane imports this subpackage."""
