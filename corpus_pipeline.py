"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, mix of sources."""

from workloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
