"""Browsing and read-only SQL over the published views of one archive."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS = 500
VIEWS = ("messages", "participants", "media", "chunks", "v_messages", "v_media", "v_searchable")
TABLE_FUNCTIONS = ("sessions_at", "explode", "explode_outer", "posexplode", "inline", "stack", "range")
# Groups of Spark's own functions that a query may call. The group of the rest calls JVM code or shows the environment;
# functions registered by users have no group.
FUNCTION_GROUPS = (
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs",
    "struct_funcs", "url_funcs", "window_funcs",
)
# Node types of a plain query; anything else (commands, writes, scripts) is refused.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "SubqueryAlias",
    "UnresolvedWith", "Distinct", "Union", "Except", "Intersect", "WithWindowDefinition", "UnresolvedHaving",
    "Generate", "Pivot", "Unpivot", "OneRowRelation", "LateralJoin", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedTableValuedFunction", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "Window", "Tail",
}


def time_bounds(after: str | None, before: str | None) -> tuple[Column | None, Column | None]:
    """Inclusive bounds; a bare date means its whole day."""

    def bound(value, rest):
        if not value:
            return None
        value = value.strip()
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            value = f"{value} {rest}"
        return F.lit(value).cast("timestamp_ntz")

    return bound(after, "00:00:00"), bound(before, "23:59:59")


def filter_time_range(df: DataFrame, after: str | None = None, before: str | None = None, ts: str = "ts") -> DataFrame:
    low, high = time_bounds(after, before)
    if low is not None:
        df = df.where(F.col(ts) >= low)
    if high is not None:
        df = df.where(F.col(ts) <= high)
    return df


def browse_filter(content: DataFrame, q: str | None = None, sender: str | None = None, msg_type: str | None = None,
                  after: str | None = None, before: str | None = None) -> DataFrame:
    if q:
        content = content.where(F.lower("content").contains(q.lower()))
    if sender:
        content = content.where(F.lower("sender").contains(sender.lower()))
    if msg_type:
        content = content.where(F.col("msg_type") == msg_type)
    return filter_time_range(content, after, before)


def browse_messages(content: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """One page by time; ``browse_filter(...).count()`` is the total. A page of more than ``MAX_ROWS`` is refused."""
    if not 0 <= limit <= MAX_ROWS:
        raise ValueError(f"a page holds 0 to {MAX_ROWS} rows, not {limit}")
    page = browse_filter(content, **filters).select("archive_id", "msg_id", "ts", "sender", "msg_type", "content")
    return page.orderBy("ts", "archive_id", "msg_id").offset(offset).limit(limit)


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _check(spark: SparkSession, query: str) -> None:
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    functions = set()

    def walk_expression(expr):
        if expr.getClass().getSimpleName() == "UnresolvedFunction":
            functions.add(expr.nameParts().mkString(".").lower())
        for child in _items(expr.children()):
            walk_expression(child)

    def walk(node, known):
        """``known``: names that WITH clauses around or before this node define."""
        kind = node.getClass().getSimpleName()
        if kind not in QUERY_NODES:
            raise PermissionError(f"only plain queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = node.multipartIdentifier().mkString(".")
            if name.lower() not in VIEWS and name.lower() not in known:
                raise PermissionError(f"relation {name} is not published")
        elif kind == "UnresolvedTableValuedFunction":
            name = node.name().mkString(".").lower()
            if name not in TABLE_FUNCTIONS:
                raise PermissionError(f"table function {name} is not allowed")
        elif kind == "UnresolvedWith":
            for relation in _items(node.cteRelations()):
                walk(relation._2(), known)
                known = known | {relation._1().lower()}
            for child in _items(node.children()):
                walk(child, known)
            return
        for expr in _items(node.expressions()):
            walk_expression(expr)
        for inner in _items(node.innerChildren()):
            walk(inner, known)
        for child in _items(node.children()):
            walk(child, known)

    walk(plan, frozenset())
    registry = spark._jsparkSession.sessionState().functionRegistry()
    for name in sorted(functions):
        known = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if known.isEmpty() or known.get().getGroup() not in FUNCTION_GROUPS:
            raise PermissionError(f"function {name} is not allowed")


def publish(spark: SparkSession, archive_id, views: dict[str, DataFrame]) -> SparkSession:
    """A session of its own with the views of one archive (all archives, if None) and the ``sessions_at`` table function.

    Sessions share the cluster and its cached data, not their views: several archives are open at once, and a query
    sees the one its session was made for. Settings are those of ``spark`` at this moment.
    """
    from parley.operators.sessions import SESSIONS_AT_SQL

    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            session.conf.set(name, value)
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in views.items():
        if name not in VIEWS:
            raise ValueError(f"{name} is not a published view")
        shown = df if archive_id is None else df.where(F.col("archive_id") == F.lit(archive_id))
        dataset.ofRows(session._jsparkSession, shown._jdf.logicalPlan()).createOrReplaceTempView(name)
    if "messages" in views:
        session.sql(SESSIONS_AT_SQL)
    return session


def run_sql(spark: SparkSession, query: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """One read-only query over the views of a session that ``publish`` made: up to ``max_rows`` rows, and in ``truncated`` whether there were more.

    With None all rows are given, spread as the query leaves them. Spark's own parser decides what the text is. Raises PermissionError for anything but a
    query over published names, and Spark's ParseException for several statements.
    """
    if not query or not query.strip():
        raise PermissionError("empty query")
    _check(spark, query)
    if max_rows is None:
        return spark.sql(query).withColumn("truncated", F.lit(False))
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    # one row beyond the cap tells; the windows see no more rows than that
    rows = spark.sql(query).limit(max_rows + 1)
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    everything = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_place", place).withColumn("truncated", F.count(F.lit(1)).over(everything) > max_rows)
    return rows.where(F.col("_place") <= max_rows).drop("_place")
