"""Knowledge-base analytics on Spark.

DataFrame operators (``operators``), Column functions (``functions``), readers
and writers (``sources``), Structured Streaming jobs (``streaming``) and the
end-to-end queries that combine them (``plans``).
"""

from mnemospark.session import build_session, prepare

__all__ = ["build_session", "prepare"]
