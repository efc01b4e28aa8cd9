"""The corpus pipeline's stages, for whoever runs them one by one; they are made in ``noticeboard.llm.pipeline``."""

from noticeboard.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
