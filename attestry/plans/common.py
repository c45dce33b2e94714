"""What queries share: the driver's documents as a tree of files, inline relations, and SQL for DuckDB."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import relations as R
from attestry.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source/doc_id.lang, in the order of doc_id."""
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    return table(spark, sf_dir, "documents").select(path.alias("relative_path"), F.col("n_chars").alias("size"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("walk_pos"))


FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS relative_path, n_chars AS size, coalesce(text, '') AS content, doc_id AS walk_pos FROM documents)"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: DuckDB's names of the types that relations have.
TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, dict):
        return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in value.items()) + "}"
    if isinstance(value, str):
        return " || chr(0) || ".join(map(quoted, value.split("\0")))
    return json.dumps(value)


def values(name: str, data: list[dict], ddl: str) -> str:
    """A common table of inline rows. Needs no session."""
    columns = [c.rsplit(" ", 1) for c in re.split(r", ", ddl)]
    each = ", ".join("(" + ", ".join(f"CAST({_literal(r.get(c))} AS {TYPES[t]})" for c, t in columns) + ")" for r in data)
    named = ", ".join(f'"{c}"' for c, _ in columns)
    return f"{name}({named}) AS (VALUES {each})"


def rows(spark: SparkSession, data: list[dict], ddl: str) -> DataFrame:
    return R.rows(spark, data, ddl)


def _keyed(ddl: str, key: str, n: int) -> str:
    """Each document with the rows of one key, whose name gets the document's number; SQL that Spark and DuckDB read alike."""
    columns = [c.rsplit(" ", 1)[0] for c in re.split(r", ", ddl)]
    return "SELECT " + ", ".join(f"t.{c} || '_' || doc_id AS {c}" if c == key else f"t.{c}" for c in columns) + f" FROM {{documents}} d JOIN {{shapes}} t ON t.k = d.doc_id % {n}"


def keyed(spark: SparkSession, sf_dir: str, data: list[dict], ddl: str, key: str, keys: list[str]) -> DataFrame:
    """Inline rows for each document: those whose key stands at the document's number, modulo the number of keys."""
    shapes = rows(spark, [{**d, "k": keys.index(d[key])} for d in data], f"k int, {ddl}")
    return spark.sql(_keyed(ddl, key, len(keys)), documents=table(spark, sf_dir, "documents"), shapes=F.broadcast(shapes))  # a few inline rows


def keyed_sql(name: str, data: list[dict], ddl: str, key: str, keys: list[str]) -> str:
    shapes = values(f"{name}_shapes", [{**d, "k": keys.index(d[key])} for d in data], f"k int, {ddl}")
    return f"{shapes}, {name} AS ({_keyed(ddl, key, len(keys)).format(documents='documents', shapes=f'{name}_shapes')})"


def redacted_sql(x: str) -> str:
    def one(sql: str, rule: tuple[str, str]) -> str:
        pattern, to = rule
        to = to.replace("\\$", "\0").replace("\\{", "{").replace("\\}", "}").replace("$", "\\").replace("\0", "$")
        return f"regexp_replace({sql}, {quoted(pattern)}, {quoted(to)}, 'g')"

    return reduce(one, T.REDACTIONS, x)


def snippet_sql(x: str) -> str:
    return redacted_sql(f"substr(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), 1, 300)")


def semantic_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '\\b\\d+\\b', '#', 'g'), ' '))"


def joined_sql(*parts: str) -> str:
    return " || chr(0) || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)


def fingerprint_sql(engine: str, rule_id: str, path: str, snippet: str) -> str:
    return f"sha256({joined_sql(engine, rule_id, path, semantic_sql(f'coalesce({snippet}, {quoted(chr(39) * 0)})'))})"


def signal_id_sql(fp: str, line: str) -> str:
    return f"'sig_' || substr(sha256({joined_sql(fp, line, quoted(''))}), 1, 16)"


RANK = "(CASE {} WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END)"


def rank_sql(x: str) -> str:
    return RANK.format(x)
