"""Plumbline: reconciliation of geodata registers and training-data jobs on Spark."""
