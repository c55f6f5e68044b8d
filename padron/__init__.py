"""Public-statistics lakes on Spark: ingest, indicators, answers, records, moderation."""

from padron.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
