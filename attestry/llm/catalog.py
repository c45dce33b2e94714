"""The training-data queries and their SQL."""

import importlib
import pkgutil

import attestry.llm as package

_PARTS = [importlib.import_module(f"attestry.llm.{m.name}") for m in pkgutil.iter_modules(package.__path__) if m.name.startswith("op")]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
