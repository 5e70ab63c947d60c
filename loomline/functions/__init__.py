"""Scalar functions as Spark column expressions; Arrow functions where an expression cannot do it."""
