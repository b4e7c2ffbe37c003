"""Call graph by joins: every rule gives candidates, and the first rule that decides wins."""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PYTHON_BUILTINS = tuple(sorted(n for n in dir(builtins) if not n.startswith("_")))
JS_BUILTINS = tuple(
    sorted(
        "parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent encodeURI decodeURI setTimeout setInterval clearTimeout clearInterval setImmediate queueMicrotask structuredClone "
        "fetch require alert Array Object String Number Boolean Symbol BigInt Map Set WeakMap WeakSet Promise Proxy Date RegExp Error TypeError RangeError JSON Math Function".split()
    )
)
SELF = ("self", "cls", "this")


def functions_of(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin("function", "method")).select(F.col("node_id").alias("callee_id"), F.col("path").alias("callee_path"), F.col("name").alias("callee_name"), "parent_class", "start_byte", (F.col("end_byte") - F.col("start_byte")).alias("span"))


def own_sites(sites: DataFrame) -> DataFrame:
    """Call sites that name no built-in of their language."""
    js = F.col("path").rlike(r"\.(js|mjs|cjs|jsx|ts|tsx)$")
    return sites.filter(~F.when(js, F.col("callee_name").isin(*JS_BUILTINS)).otherwise(F.col("callee_name").isin(*PYTHON_BUILTINS)))


def _tally() -> list:
    """How many functions there are, one of them, and the same of those outside of classes."""
    free = F.col("parent_class").isNull()
    return [F.count(F.lit(1)).alias("n"), F.min("callee_id").alias("only"), F.count_if(free).alias("n_free"), F.min(F.when(free, F.col("callee_id"))).alias("free")]


def resolved_calls(sites: DataFrame, nodes: DataFrame, bindings: DataFrame, instance_fallback: bool = False) -> DataFrame:
    """site_id, caller_id, statement_id, callee_id, rule.

    Rules in order: 1 a method of the caller's class (self, cls, this; nothing else is tried then); without a
    receiver 2 the same file, 3 any file; with one 4 a function of an imported module, 5 a method of an imported
    class, 6 a method of a class of that name anywhere, 7 (instance_fallback) the only method of that name.  A
    rule takes a single match, or the single match outside of classes; several matches under rule 3 end the
    search.  Of several methods under rule 1 the longest counts, then the last.
    """
    functions = functions_of(nodes).dropDuplicates(["callee_id"])
    methods = functions.filter("parent_class is not null")
    owner = nodes.filter(F.col("kind").isin("function", "method")).select(F.col("node_id").alias("caller_id"), F.col("parent_class").alias("caller_class"))
    own = own_sites(sites).select("site_id", "path", "caller_id", "statement_id", "callee_name", "receiver").dropDuplicates(["site_id"])
    to_self = own.filter(F.col("receiver").isin(*SELF)).join(owner, "caller_id").select("site_id", F.col("path").alias("callee_path"), F.col("caller_class").alias("parent_class"), "callee_name")
    # Functions are counted by what a rule looks for, so a site meets one row a rule, however many bear its name.
    of_class = methods.groupBy("callee_path", "parent_class", "callee_name").agg(F.max_by("callee_id", F.struct("span", "start_byte")).alias("longest"), *_tally())
    first = to_self.join(of_class, ["callee_path", "parent_class", "callee_name"]).select("site_id", F.col("longest").alias("callee_id"), F.lit(1).alias("rule"))
    plain = own.filter("receiver is null").select("site_id", F.col("path").alias("callee_path"), "callee_name")
    of_file = functions.groupBy("callee_path", "callee_name").agg(*_tally())
    of_name = functions.groupBy("callee_name").agg(*_tally())
    with_receiver = own.filter(F.col("receiver").isNotNull() & ~F.col("receiver").isin(*SELF)).select("site_id", "path", "callee_name", "receiver")
    bound = with_receiver.join(bindings.select("path", F.col("local_name").alias("receiver"), F.col("resolved_path").alias("callee_path"), "imported_symbol"), ["path", "receiver"])
    candidates = {
        2: plain.join(of_file, ["callee_path", "callee_name"]),
        3: plain.join(of_name, "callee_name"),
        4: bound.filter("imported_symbol is null").join(of_file, ["callee_path", "callee_name"]),
        5: bound.withColumnRenamed("imported_symbol", "parent_class").join(of_class, ["callee_path", "parent_class", "callee_name"]),
        6: with_receiver.withColumnRenamed("receiver", "parent_class").join(methods.groupBy("parent_class", "callee_name").agg(*_tally()), ["parent_class", "callee_name"]),
    }
    if instance_fallback:
        candidates[7] = with_receiver.join(methods.groupBy("callee_name").agg(*_tally()), "callee_name")
    found = None
    for rule, hits in candidates.items():
        one = hits.select("site_id", F.lit(rule).alias("rule"), "n", "only", "n_free", "free")
        found = one if found is None else found.unionByName(one)
    per_rule = found.groupBy("site_id", "rule").agg(F.sum("n").alias("n"), F.min("only").alias("only"), F.sum("n_free").alias("n_free"), F.min("free").alias("free"))
    decided = per_rule.select("site_id", "rule", F.when(F.col("n") == 1, F.col("only")).when(F.col("n_free") == 1, F.col("free")).alias("callee_id")).filter(F.col("callee_id").isNotNull() | (F.col("rule") == 3))
    best = decided.groupBy("site_id").agg(F.min_by(F.struct("callee_id", "rule"), "rule").alias("b")).select("site_id", "b.callee_id", "b.rule").filter("callee_id is not null")
    return own.select("site_id", "caller_id", "statement_id").join(best.unionByName(first), "site_id")


def call_edges(calls: DataFrame, sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind, variable, position: Calls, CalledBy, DataFlowArgument and DataFlowReturn, each once.

    Arguments lead from the statement of the call to the callee's entry, by position among the parameters but
    for self and cls, or by name; returns lead from each return statement of the callee to the statement.
    """
    none, no_place = F.lit(None).cast("string").alias("variable"), F.lit(None).cast("int").alias("position")
    calling = calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.lit("Calls").alias("kind"), none, no_place)
    called = calls.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"), F.lit("CalledBy").alias("kind"), none, no_place)
    names = F.filter(F.transform("parameters", lambda p: p["name"]), lambda n: ~n.isin("self", "cls") & ~n.startswith("*") & ~n.startswith("..."))
    given = nodes.filter(F.col("kind").isin("function", "method")).select(F.col("node_id").alias("callee_id"), names.alias("names"))
    entry = nodes.filter("kind = 'cfg_entry'").select(F.col("function_id").alias("callee_id"), F.col("node_id").alias("entry_id"))
    full = calls.join(sites.select("site_id", "positional_args", "keyword_args").dropDuplicates(["site_id"]), "site_id").join(given, "callee_id").join(entry, "callee_id")
    by_place = full.select("statement_id", "entry_id", "names", F.posexplode("positional_args").alias("position", "arg")).filter(F.col("position") < F.size("names"))
    by_name = full.select("statement_id", "entry_id", "names", F.explode("keyword_args").alias("k")).withColumn("position", (F.array_position("names", F.col("k.name")) - 1).cast("int")).filter("position >= 0")
    argument = by_place.select("statement_id", "entry_id", "names", "position").unionByName(by_name.select("statement_id", "entry_id", "names", "position"))
    argument = argument.select(F.col("statement_id").alias("src"), F.col("entry_id").alias("dst"), F.lit("DataFlowArgument").alias("kind"), F.col("names")[F.col("position")].alias("variable"), F.col("position").cast("int").alias("position"))
    returns = nodes.filter("statement_kind = 'return'").select(F.col("function_id").alias("callee_id"), F.col("node_id").alias("src"))
    back = calls.join(returns, "callee_id").select("src", F.col("statement_id").alias("dst"), F.lit("DataFlowReturn").alias("kind"), none, no_place)
    return calling.unionByName(called).unionByName(argument).unionByName(back).distinct()


def callees(calls: DataFrame, nodes: DataFrame, path: str, name: str) -> DataFrame:
    """name, path, start_line of what the functions of a name in a file call."""
    who = nodes.filter((F.col("path") == path) & (F.col("name") == name) & F.col("kind").isin("function", "method")).select(F.col("node_id").alias("caller_id"))
    ends = nodes.select(F.col("node_id").alias("callee_id"), "name", "path", "start_line")
    return calls.join(who, "caller_id", "left_semi").join(ends, "callee_id").select("name", "path", "start_line").distinct()


def callers(calls: DataFrame, nodes: DataFrame, path: str, name: str) -> DataFrame:
    """name, path, start_line of the functions that call those of a name in a file."""
    who = nodes.filter((F.col("path") == path) & (F.col("name") == name) & F.col("kind").isin("function", "method")).select(F.col("node_id").alias("callee_id"))
    ends = nodes.select(F.col("node_id").alias("caller_id"), "name", "path", "start_line")
    return calls.join(who, "callee_id", "left_semi").join(ends, "caller_id").select("name", "path", "start_line").distinct()


def kill_pairs(nodes: DataFrame) -> DataFrame:
    """node_id, killed_id, variable: other definitions of a variable in one function."""
    defs = nodes.filter("function_id is not null").select("function_id", "node_id", F.explode("defs").alias("variable"))
    other = defs.select("function_id", "variable", F.col("node_id").alias("killed_id"))
    return defs.join(other, ["function_id", "variable"]).filter("node_id <> killed_id").select("node_id", "killed_id", "variable")


def reaching_by_joins(defs: DataFrame, uses: DataFrame, flow: DataFrame) -> DataFrame:
    """def_id, use_id, variable, by a semi-naive closure over control flow: the cross-check of the parser's own.

    defs and uses have node_id, variable; flow has src, dst.  Each step follows only what the last one found, until
    nothing is new: there are finitely many facts, so it ends.
    """
    from ..tables import written

    flow = flow.select("src", "dst").distinct()
    front = defs.select(F.col("node_id").alias("def_id"), "variable", F.col("node_id").alias("at"))
    into = None
    while True:
        new = front.join(flow, front["at"] == flow["src"]).select("def_id", "variable", F.col("dst").alias("at")).distinct()
        new = new if into is None else new.join(into, ["def_id", "variable", "at"], "left_anti")
        new = written(new, "reach")
        if new.isEmpty():
            break
        into = new if into is None else into.unionByName(new)
        # A redefinition takes the value in, and hands its own on.
        front = new.join(defs.select(F.col("node_id").alias("at"), "variable"), ["at", "variable"], "left_anti")
    if into is None:
        return defs.limit(0).select(F.col("node_id").alias("def_id"), F.col("node_id").alias("use_id"), "variable")
    return into.join(uses.select(F.col("node_id").alias("at"), "variable"), ["at", "variable"]).select("def_id", F.col("at").alias("use_id"), "variable").distinct()


def innermost(sites: DataFrame) -> DataFrame:
    """One row for each call expression, at the smallest statement that holds it."""
    by = Window.partitionBy("path", "start_byte", "end_byte", "callee_name").orderBy("statement_id")
    return sites.withColumn("nth", F.row_number().over(by)).filter("nth = 1").drop("nth")
