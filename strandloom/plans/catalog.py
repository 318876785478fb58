"""All registered queries of the engine and their DuckDB equivalents."""

from strandloom.plans import aggregates, assembly, files, forensics, joins, sequences, windows  # noqa: F401  they register themselves
from strandloom.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "q_window_coverage"
