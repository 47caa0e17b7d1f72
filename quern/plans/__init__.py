"""All queries are registered when the package is imported."""

from quern.plans import catalogue, serving

__all__ = ["catalogue", "serving"]
