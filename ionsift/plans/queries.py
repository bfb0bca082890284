"""The engine's queries by name, each over (spark, sf_dir), and their SQL."""

from . import bonuses, composed, evaluating, features, fusing, gates, learners, retrieval, scalars, spectra, structures  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
