"""The training corpus in five stages: quality rules, one document of each near-duplicate group, no benchmark passages, sources mixed to
weights, token files. The stages are those of ``callweave.llm.pipeline``."""

from callweave.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
