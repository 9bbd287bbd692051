"""Static checks of SQL text: parsed without running, its plan held against lists, node by node.

Nothing is judged by the text itself.  A plan that can't be read to the end is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# What a query's plan may consist of at its root, what no part of it may be, and functions it may not call, by name and by the analysed plan's class.
ROOTS = frozenset("Project Aggregate Filter Sort GlobalLimit LocalLimit Limit Distinct Deduplicate Union Intersect Except Join Window WithWindowDefinition UnresolvedWith UnresolvedHaving UnresolvedInlineTable SubqueryAlias Pivot Unpivot Offset Tail Sample UnresolvedSubqueryColumnAliases UnresolvedRelation LateralJoin".split())
COMMANDS = ("Command", "InsertInto", "Create", "Drop", "Alter", "SetCatalog", "CompoundBody", "Truncate", "Delete", "Update", "Merge", "Cache", "Uncache", "Script", "LoadData", "Explain")
DENIED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user current_catalog current_database current_schema python_udf read_files".split())
DENIED_CLASSES = frozenset("CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength CurrentUser CurrentCatalog CurrentDatabase PythonUDF PythonUDTF ScalaUDF".split())
FILES = frozenset("parquet csv json orc text binaryfile avro xml delta".split())
_PLAN = "org.apache.spark.sql.catalyst.plans.QueryPlan"


@dataclass
class Checked:
    is_valid: bool
    violations: list[str] = field(default_factory=list)
    sql: str = ""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(spark: SparkSession, plan, views: bool = True) -> Iterator[tuple[str, object]]:
    """(class name, node) of a plan's operators and expressions, those of subqueries and common tables included;
    without ``views``, not of what stands below a view."""
    gateway = spark.sparkContext._gateway
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        yield name, node
        if name == "View" and not views:
            continue
        todo += _items(node.children()) + _items(node.innerChildren())
        if is_instance_of(gateway, node, _PLAN):
            todo += _items(node.expressions())


def _unknown(spark: SparkSession, plan, columns: set[str]) -> list[str]:
    """Names of the tables' columns that the analysed plan uses and that are not among ``columns``.  Names that the query makes itself are its own."""
    nodes = list(_nodes(spark, plan, views=False))
    gateway = spark.sparkContext._gateway
    leaves = [n for name, n in nodes if is_instance_of(gateway, n, _PLAN) and (name == "View" or n.children().size() == 0)]
    stored = {a.exprId().toString(): a.name() for n in leaves if n.getClass().getSimpleName() not in ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef") for a in _items(n.output())}
    used = {n.exprId().toString() for name, n in nodes if name == "AttributeReference"}
    return sorted({stored[x] for x in used if x in stored} - columns)


def check_sql(spark: SparkSession, sql: str, columns: set[str] | None = None) -> Checked:
    """All violations of ``sql``.  ``columns``: the columns of tables that it may read, if given.

    Nothing runs: the text is parsed, and only a text that passes the lists is analyzed."""
    if not sql or not sql.strip():
        return Checked(False, ["empty query"])
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # Spark's or the parser's own Java exceptions
        return Checked(False, [f"syntax error: {str(e).splitlines()[0]}"])
    root = plan.getClass().getSimpleName()
    found = [] if root in ROOTS else [f"statement {root} is not allowed"]
    try:
        for name, node in _nodes(spark, plan):
            if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
                parts = [str(x).lower() for x in _items(node.nameParts() if name == "UnresolvedFunction" else node.name())] if name != "UnresolvedTVFAliases" else []
                found += [f"function {x} is not allowed" for x in parts[-1:] if x in DENIED]
            elif name == "UnresolvedRelation":
                parts = [str(x).lower() for x in _items(node.multipartIdentifier())]
                if len(parts) > 1 and parts[0] in FILES:
                    found.append("files by path are not allowed")
            elif node is not plan and any(name.startswith(c) or name.endswith(c) for c in COMMANDS) and not name.startswith(("CreateArray", "CreateMap", "CreateNamedStruct", "CreateStruct", "UpdateFields", "DropField")):
                found.append(f"node {name} is not allowed")
    except Exception as e:
        found.append(f"the plan can't be read: {type(e).__name__}")
    found = list(dict.fromkeys(found))
    if found:
        return Checked(False, found)
    try:
        analyzed = spark.sql(sql)._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        return Checked(False, [f"{e.getCondition() or 'ANALYSIS'}: {str(e).splitlines()[0]}"])
    try:
        found = [f"function {name} is not allowed" for name, _ in _nodes(spark, analyzed, views=False) if name in DENIED_CLASSES]
        if columns is not None:
            found += [f"unknown column {c}" for c in _unknown(spark, analyzed, columns)]
    except Exception as e:
        found = [f"the plan can't be read: {type(e).__name__}"]
    return Checked(not found, found, sql if not found else "")
