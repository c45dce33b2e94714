"""All queries of the reference part, with their SQL."""

from attestry.plans import code, contracts, modules, packages, packs, reports, scans, semantics, trees

_PARTS = (packs, trees, reports, code, scans, contracts, modules, semantics, packages)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
flagship = scans.scan_decision
