"""graphlens: architecture-graph analytics as PySpark DataFrame jobs."""

from graphlens.graph import Graph

__all__ = ["Graph"]
