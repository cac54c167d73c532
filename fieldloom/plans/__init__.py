"""All queries by name, and the DuckDB text of those that SQL can express."""

from . import curation, detection, evaluation, labelling, places, rigs, selection, timelines, vector_search, versions

MODULES = (selection, timelines, vector_search, evaluation, detection, places, rigs, curation, labelling, versions)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: text for m in MODULES for name, text in m.ORACLES.items()}
