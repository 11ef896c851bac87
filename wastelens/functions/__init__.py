"""Column-level helpers (pure expressions, stay inside whole-stage codegen)."""

from wastelens.functions.scalars import *  # noqa: F401,F403
