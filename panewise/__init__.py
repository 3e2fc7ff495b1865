"""Windowed, chainable analytics over tables and streams, built on Spark DataFrames."""

from panewise.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
