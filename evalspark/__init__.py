"""Evaluation of machine-written answers as Spark DataFrame work."""
