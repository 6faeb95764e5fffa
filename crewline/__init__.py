"""Shift-workforce analytics as Spark DataFrame operators and marts."""
