"""Governed data-asset knowledge on Spark: compile, index, search, relate, bind, evaluate."""

__version__ = "0.1.0"
