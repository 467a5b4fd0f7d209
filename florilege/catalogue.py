"""The engine's registered queries and their SQL."""

from florilege.plans import catalog, content, entries, matching, nested, profiles, quality, sourced, words  # noqa: F401  they register themselves
from florilege.registry import COVERS, ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "issue_report"
