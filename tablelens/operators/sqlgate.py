"""Read-only SQL over registered views, judged by its parsed plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Relations that may never be read.
PRIVATE_TABLES = ("users", "refresh_tokens", "user_dashboards", "semantic_memory")
# The only plan nodes a statement may have: no commands, scripts, table functions or hints.
PLAIN_NODES = frozenset(
    """Aggregate CTERelationDef Distinct Except Filter GlobalLimit Intersect Join LateralJoin LocalLimit Offset OneRowRelation
    Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedWith WithWindowDefinition""".split()
)
# Groups of built-in functions that compute from their arguments alone, and those among them that do not.
OPEN_GROUPS = frozenset(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs
    json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs window_funcs""".split()
)
RANDOM_FUNCTIONS = frozenset("rand random randn randstr uniform shuffle".split())


class NotAllowed(ValueError):
    """The statement is not a plain read of allowed tables."""


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _walk(node, plans: list, functions: list, relations: list, scope: frozenset[str]) -> None:
    """All plan nodes below ``node`` (also in subqueries), functions called, and relations read.

    ``scope`` holds the common tables that a name can mean here.  One is known after its own body
    and inside the query that declares it, and nowhere else: in its body, its name is a table.
    """
    plans.append(node)
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        name = ".".join(_items(node.multipartIdentifier())).lower()
        if name not in scope:
            relations.append(name)
    if kind == "UnresolvedWith":
        if node.allowRecursion():
            raise NotAllowed("common tables that read themselves may not run")
        for pair in _items(node.cteRelations()):
            _walk(pair._2(), plans, functions, relations, scope)
            scope = scope | {pair._1().lower()}
    for child in _items(node.children()):
        _walk(child, plans, functions, relations, scope)
    stack = list(_items(node.expressions()))
    while stack:
        e = stack.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            functions.append(".".join(_items(e.nameParts())).lower())
        if hasattr(e, "getClass") and any(c.getSimpleName() == "SubqueryExpression" for c in _classes(e)):
            _walk(e.plan(), plans, functions, relations, scope)
        stack.extend(_items(e.children()))


def _open(spark: SparkSession, function: str) -> bool:
    """Whether a function is Spark's own (not replaced by a user's) and computes from its arguments alone."""
    registry = spark._jsparkSession.sessionState().functionRegistry()
    if "." in function:
        return False
    found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(function))
    return found.isDefined() and found.get().getSource() == "built-in" and found.get().getGroup() in OPEN_GROUPS and function not in RANDOM_FUNCTIONS


def _classes(e) -> Iterator:
    c = e.getClass()
    while c is not None:
        yield c
        c = c.getSuperclass()


def read_only_sql(spark: SparkSession, sql: str, allowed: set[str], limit: int | None = None) -> DataFrame:
    """Run a query over the ``allowed`` tables; ``limit`` holds where the statement has no limit of its own."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise NotAllowed(f"cannot parse: {str(error).splitlines()[0]}") from error
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        raise NotAllowed("a statement starts with SELECT")
    plans: list = []
    functions: list[str] = []
    relations: list[str] = []
    _walk(plan, plans, functions, relations, frozenset())
    odd = {n.getClass().getSimpleName() for n in plans} - PLAIN_NODES
    if odd:
        raise NotAllowed(f"only plain queries may run, not {sorted(odd)}")
    closed = {f for f in set(functions) if not _open(spark, f)}
    if closed:
        raise NotAllowed(f"closed functions: {sorted(closed)}")
    names = set(relations)
    private = {n for n in names if n.split(".")[-1] in PRIVATE_TABLES}
    if private:
        raise NotAllowed(f"private tables: {sorted(private)}")
    unknown = names - {a.lower() for a in allowed}
    if unknown:
        raise NotAllowed(f"unknown tables: {sorted(unknown)}")
    df = spark.sql(sql)
    limited = plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit", "Offset")
    return df if limit is None or limited else df.limit(limit)
