"""Scalar functions as Columns, and the few that need Python."""
