"""Imports all plan modules and exposes what they registered."""

from __future__ import annotations

from embedspark.plans import color, color_qa, content, image, latency, streams, text, timed_streams, vectors  # noqa: F401
from embedspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
