"""Document-grounding analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame, keyed by paper or
episode, so one call measures a whole corpus.
"""

from plumbline.session import build_session, configure

__all__ = ["build_session", "configure"]
