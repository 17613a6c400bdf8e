"""SQL that only reads: Spark's own parser tells what a query is."""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: First words of statements, by what they are; any other first word is a "statement".
_KINDS = {
    "query": {"select", "with", "values", "table", "from", "("},
    "ddl": {"create", "drop", "alter", "rename", "replace", "truncate", "cache", "uncache", "refresh", "repair", "comment", "analyze", "use", "set", "reset", "add", "load", "msck"},
    "dml": {"insert", "update", "delete", "merge", "copy"},
}
_COMMENT = re.compile(r"\s+|--[^\n]*(?:\n|$)|/\*.*?\*/", re.DOTALL)
#: Expressions whose value depends on the time of the run.
_TIMES = re.compile(r'"class":"org\.apache\.spark\.sql\.catalyst\.expressions\.(?:Current(?:Timestamp|Date|Time)|Now|LocalTimestamp)\w*"')


class PolicyError(ValueError):
    """A statement that the policy does not allow."""


def statement_kind(spark: SparkSession, sql: str) -> str:
    """query, ddl, dml or statement, by the first word.  Only a guess: what may run is told by ``safe_sql``."""
    at = 0
    while m := _COMMENT.match(sql, at):
        at = m.end()
    word = "(" if sql[at : at + 1] == "(" else re.match(r"\w*", sql[at:])[0].lower()
    return next((kind for kind, words in _KINDS.items() if word in words), "statement")


def safe_sql(spark: SparkSession, sql: str, allow: frozenset[str] = frozenset(), args=None, **tables: DataFrame) -> DataFrame:
    """Runs a query; DDL, DML and other statements only if their kind is allowed.  ``{name}`` stands for a table.

    A query is run as a subquery: whatever Spark's parser takes there is a query, so nothing else can get through, however
    it is written (EXECUTE IMMEDIATE, BEGIN ... END, CALL, WITH ... INSERT).
    """
    kind = statement_kind(spark, sql)
    if kind != "query":
        if kind not in allow:
            raise PolicyError(f"{kind} statements are not allowed")
        return spark.sql(sql, args=args, **tables)
    try:
        return spark.sql(f"SELECT * FROM (\n{sql.strip().removesuffix(';')}\n)", args=args, **tables)
    except ParseException as e:
        raise PolicyError(f"not a query: {str(e).splitlines()[0]}") from None


def require_deterministic(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rejects plans with a function without a fixed value; ``strict`` rejects the time of the run too.

    The analysed plan itself says so, expression by expression, however wide it is.  PySpark has no public call for it.
    """
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        raise PolicyError("not deterministic")
    if strict and (found := _TIMES.search(plan.toJSON())):
        raise PolicyError(f"depends on the time of the run: {found[0]}")
    return df


def plan_fingerprint(df: DataFrame) -> str:
    """sha256 of the canonical plan's hash and of the schema: equal for plans that differ in names of instances alone."""
    return hashlib.sha256(f"{df.semanticHash()}:{df.schema.json()}".encode()).hexdigest()


def pushed_filters(df: DataFrame) -> list[str]:
    """What the scans of the physical plan were given."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def register_macro(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """A SQL macro: a temporary SQL function, which Spark inlines.  ``returns`` may be TABLE (...)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
