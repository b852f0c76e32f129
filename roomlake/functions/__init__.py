"""Scalar functions as SQL expressions that stay inside whole-stage codegen."""
