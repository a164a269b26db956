"""All registered queries (importing the gate modules fills the registry)."""

from lexiflow.plans.gates import alignment, arrays, correction, order, scoring, tables, tokenizer, tokenizer_few, training, sessions  # noqa: F401
from lexiflow.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
