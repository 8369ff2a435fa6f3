"""Scalar column functions."""
from shelfspark.functions.scalars import *  # noqa: F401,F403
