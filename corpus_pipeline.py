"""The corpus pipeline: documents through quality, toxicity, line and near-duplicate filters into packed sequences.

The stages are in ``cinderloom.llm.pipeline``; this file gives them the names that callers expect here.
"""

from cinderloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
