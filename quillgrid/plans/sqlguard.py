"""Admission of user SQL: one SELECT over known relations, without functions that reach outside.

The statement is parsed, not run; every node of the parsed plan must be on the list of query nodes, every
relation must be registered, and every function must be built in and of an admitted group. The parser is reached through the
session's JVM side, which is why this is in one module; what does not change, the kinds of nodes and the groups of
functions, is asked for once.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..errors import EngineError, UnsupportedError

#: Parsed plan nodes that only query.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation WithWindowDefinition UnresolvedPivot Pivot Unpivot LateralJoin Generate Window Sample UnresolvedHint UnresolvedTableValuedFunction AsOfJoin ResolvedInlineTable UnresolvedTVFAliases UnresolvedOrdinal".split()
)
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Groups of built-in functions that compute from their arguments alone, and functions of other groups that do.
GROUPS = frozenset("math_funcs agg_funcs generator_funcs datetime_funcs array_funcs string_funcs map_funcs predicate_funcs bitwise_funcs window_funcs json_funcs conversion_funcs lambda_funcs conditional_funcs hash_funcs struct_funcs collection_funcs url_funcs".split())
OTHERS = frozenset("typeof".split())
#: Words that Spark reads as functions of the session, unless a column has that name.
SESSION_WORDS = frozenset("user current_user session_user current_catalog current_schema current_database".split())

_NAMED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\$(\w+)""", re.S)


@contextmanager
def dialect(spark: SparkSession):
    """Double quotes name identifiers and files are no tables while a statement is read; settings are restored."""
    wanted = {"spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.ansi.enabled": "true", "spark.sql.runSQLOnFiles": "false"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def named_parameters(sql: str) -> str:
    """$name, outside of literals and comments, as :name; numbered ones are refused."""

    def put(m):
        if m[1] is None:
            return m[0]
        if m[1].isdigit():
            raise UnsupportedError("numbered parameters are not supported; use ? or $name")
        return f":{m[1]}"

    return _NAMED.sub(put, sql)


_KINDS: dict[str, tuple[str, bool, bool]] = {}
_GROUPS: dict[str, bool] = {}


def _traits(node) -> tuple[str, bool, bool]:
    """The node's kind, whether it is a plan, and whether it holds a subquery's plan."""
    name = node.getClass().getName()
    if name not in _KINDS:
        _KINDS[name] = _kind(node), _is_plan(node), _has(node, "plan")
    return _KINDS[name]


def _admitted(spark: SparkSession, name: str) -> bool:
    if name not in _GROUPS:
        registry = spark._jsparkSession.sessionState().functionRegistry()
        told = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        # functions of a session, which others may register, have no group
        _GROUPS[name] = name in OTHERS or told.isDefined() and str(told.get().getGroup()) in GROUPS
    return _GROUPS[name]


def admit(spark: SparkSession, sql: str, relations: set[str], columns: set[str] = frozenset()) -> None:
    """Raise unless sql is one SELECT over the relations and their columns (compared without case)."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise EngineError(f"not one valid SELECT: {str(e).splitlines()[0][:300]}") from e
    known = {r.casefold() for r in relations}
    words = SESSION_WORDS - {c.casefold() for c in columns}
    todo: list[tuple] = [(plan, frozenset())]
    while todo:
        node, local = todo.pop()
        kind, is_plan, holds_plan = _traits(node)
        if is_plan:
            if kind not in NODES:
                raise UnsupportedError(f"only one SELECT is answered, not {kind}")
            if kind == "UnresolvedRelation":
                parts = [str(p) for p in _items(node.multipartIdentifier())]
                if len(parts) != 1 or parts[0].casefold() not in known | local:
                    raise EngineError(f"unknown relation {'.'.join(parts)}")
            if kind == "UnresolvedTableValuedFunction":
                name = ".".join(str(p) for p in _items(node.name())).casefold()
                if name not in TABLE_FUNCTIONS:
                    raise UnsupportedError(f"table function {name} is refused")
            if kind == "UnresolvedWith":
                for pair in _items(node.cteRelations()):
                    alias, query = str(pair._1()), pair._2()
                    todo.append((query, local))
                    local = local | {alias.casefold()}
            todo += [(e, local) for e in _items(node.expressions())]
            todo += [(c, local) for c in _items(node.children())]
            if kind == "LateralJoin":
                todo.append((node.right(), local))
            continue
        if kind == "UnresolvedFunction":
            name = ".".join(str(p) for p in _items(node.nameParts())).casefold()
            if not _admitted(spark, name):
                raise UnsupportedError(f"function {name} is refused")
        elif kind == "UnresolvedGenerator":
            name = str(node.name().funcName()).casefold()
            if name not in TABLE_FUNCTIONS:
                raise UnsupportedError(f"table function {name} is refused")
        elif kind == "UnresolvedAttribute" and node.nameParts().size() == 1:
            name = str(node.nameParts().apply(0)).casefold()
            if name in words:
                raise UnsupportedError(f"{name} is refused")
        todo += [(c, local) for c in _items(node.children())]
        if holds_plan:
            todo.append((node.plan(), local))


def _is_plan(node) -> bool:
    kind = node.getClass()
    while kind is not None:
        if kind.getName() == "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan":
            return True
        kind = kind.getSuperclass()
    return False


def _has(node, method: str) -> bool:
    """Whether the object has a public method of that name without arguments."""
    return any(m.getName() == method and m.getParameterCount() == 0 for m in node.getClass().getMethods())
