"""Structured Streaming forms of the live operators."""

from .live import *  # noqa: F403
