"""The file graph as relations: edges, their upgrade, lookups, statistics, differences and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FAMILY_OF, LANGUAGE_OF, STRENGTH
from ..tables import fits, small, written

NOISY_DEFINITIONS = 5


def strength_of(kind: Column) -> Column:
    return F.when(kind == "Import", STRENGTH["Import"]).otherwise(STRENGTH["SymbolUsage"])


def language_of(path: Column) -> Column:
    """Language by extension, in any case; null where it is unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    found = F.lit(None).cast("string")
    for ext, lang in LANGUAGE_OF.items():
        found = F.when(extension == ext, lang).otherwise(found)
    return found


def family_of(language: Column) -> Column:
    found = F.lit(None).cast("string")
    for lang, family in FAMILY_OF.items():
        found = F.when(language == lang, family).otherwise(found)
    return found


def upgraded_edges(candidates: DataFrame) -> DataFrame:
    """src, dst, kind, strength: one edge for each pair, Import before SymbolUsage, no edge to itself."""
    best = candidates.filter("src <> dst").groupBy("src", "dst").agg(F.min("kind").alias("kind"))
    return best.withColumn("strength", strength_of(F.col("kind")))


def noisy_symbols(definitions: DataFrame, limit: int = NOISY_DEFINITIONS, compat: str | None = None, noisy: bool = True) -> DataFrame:
    """Names defined in more than limit files, with their number, or else the others; compat "reference" counts every definition."""
    count = F.count("path") if compat == "reference" else F.count_distinct("path")
    return definitions.groupBy("name").agg(count.alias("n_definitions")).filter((F.col("n_definitions") > limit) if noisy else (F.col("n_definitions") <= limit))


def symbol_usage_edges(definitions: DataFrame, usages: DataFrame, gate: DataFrame | None = None, limit: int = NOISY_DEFINITIONS, compat: str | None = None) -> DataFrame:
    """src, dst of files that use a name another file defines.

    definitions and usages have path, name and family (of languages that go together); names defined too often
    are left out before the join, which keeps it from blowing up on common names; gate (src, dst) keeps the
    pairs that it has.  The few definitions that stay are a written table, whose size is known: as long as it is
    small it goes to the usages, which are not shuffled; beyond that hashes of its names do, and only usages that
    meet one are shuffled.
    """
    keep = definitions.select("path", "name", "family")
    few = noisy_symbols(definitions if compat == "reference" else keep.distinct(), limit, compat, noisy=False)
    few = written(few.select("name"), "names")
    keep = written(keep.join(small(few), "name", "left_semi").distinct().withColumnRenamed("path", "dst"), "definitions")
    used = usages.select(F.col("path").alias("src"), "name", "family")
    if not fits(keep):
        hashed = F.xxhash64("name", "family").alias("hash")
        hashes = written(keep.select(hashed).distinct(), "hashes")
        if fits(hashes):
            used = used.withColumn("hash", hashed).join(F.broadcast(hashes), "hash", "left_semi").drop("hash")
    # A repeated usage makes a repeated pair, and those are made one below.
    pairs = used.join(small(keep), ["name", "family"]).filter("src <> dst").select("src", "dst").distinct()
    return pairs if gate is None else pairs.join(gate.select("src", "dst"), ["src", "dst"], "left_semi")


def dependencies(edges: DataFrame, node) -> DataFrame:
    """What node leads to, and how."""
    return edges.filter(F.col("src") == F.lit(node)).select(F.col("dst").alias("path"), "kind")


def dependents(edges: DataFrame, node) -> DataFrame:
    """What leads to node, and how."""
    return edges.filter(F.col("dst") == F.lit(node)).select(F.col("src").alias("path"), "kind")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: n_nodes, n_edges, n_import, n_symbol, n_isolated, n_dangling."""
    kinds = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("kind") == "Import").alias("n_import"), F.count_if(F.col("kind") == "SymbolUsage").alias("n_symbol"))
    ends = edges.select(F.col("src").alias("path"), F.lit(1).alias("out")).unionByName(edges.select(F.col("dst").alias("path"), F.lit(0).alias("out")))
    degree = ends.groupBy("path").agg(F.max("out").alias("out"))
    per_node = nodes.select("path").join(degree, "path", "left")
    counts = per_node.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("out").isNull()).alias("n_isolated"), F.count_if(F.coalesce(F.col("out"), F.lit(0)) == 0).alias("n_dangling"))
    return counts.crossJoin(kinds).select("n_nodes", "n_edges", "n_import", "n_symbol", "n_isolated", "n_dangling")


def health(stats: DataFrame) -> DataFrame:
    """status and issues from a row of statistics()."""
    empty, no_edges, no_symbols = F.col("n_nodes") == 0, (F.col("n_nodes") > 10) & (F.col("n_edges") == 0), (F.col("n_nodes") > 5) & (F.col("n_symbol") == 0)
    issues = F.array_compact(F.array(F.when(empty, "no files"), F.when(no_edges, "no edges"), F.when(no_symbols, "no symbol edges")))
    status = F.when(empty, "critical").when(F.size("issues") == 0, "healthy").when(F.size("issues") <= 2, "degraded").otherwise("critical")
    return stats.withColumn("issues", issues).select(status.alias("status"), "issues")


def unresolved(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets that are no node, with the number of distinct files that wait for them. resolved: src, dst."""
    missing = resolved.join(nodes.select(F.col("path").alias("dst")), "dst", "left_anti")
    return missing.groupBy("dst").agg(F.count_distinct("src").alias("n_waiting"))


def set_hash(values: Column) -> Column:
    """Hash of an array as a set; only equality of such hashes means anything."""
    return F.xxhash64(F.array_join(F.array_sort(values), "\0"))


def classified_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change, tier from both states of files with the hashes of content, imports, definitions and usages.

    change is created, deleted, modified or unchanged; tier tells what a modification reaches: GraphScope where
    imports differ, FileScope where definitions or usages do, else Local.
    """
    hashes = ("content_hash", "imports_hash", "definitions_hash", "usages_hash")
    a = old.select("path", *(F.col(h).alias(f"old_{h}") for h in hashes), F.lit(True).alias("was"))
    b = new.select("path", *hashes, F.lit(True).alias("is"))
    both = a.join(b, "path", "full_outer")

    def same(h: str) -> Column:
        return F.col(h).eqNullSafe(F.col(f"old_{h}"))

    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(same("content_hash"), "unchanged").otherwise("modified")
    tier = F.when(F.col("change") != "modified", F.when(F.col("change") == "unchanged", "Local").otherwise("GraphScope")).when(~same("imports_hash"), "GraphScope").when(~(same("definitions_hash") & same("usages_hash")), "FileScope").otherwise("Local")
    return both.withColumn("change", change).withColumn("tier", tier).select("path", "change", "tier")


def edge_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """src, dst, kind, change: added or removed."""
    cols = ["src", "dst", "kind"]
    return new.select(cols).exceptAll(old.select(cols)).withColumn("change", F.lit("added")).unionByName(old.select(cols).exceptAll(new.select(cols)).withColumn("change", F.lit("removed")))


def change_counts(differences: DataFrame) -> DataFrame:
    """One row: edges_added, edges_removed, dirty (whether ranks have to be made anew), from edge_differences()."""
    added, removed = (F.count_if(F.col("change") == c) for c in ("added", "removed"))
    return differences.agg(added.alias("edges_added"), removed.alias("edges_removed"), (F.count(F.lit(1)) > 0).alias("dirty"))


def upserted(files: DataFrame, changed: DataFrame) -> DataFrame:
    """files with the rows of changed in place of those of the same path."""
    return files.join(changed.select("path"), "path", "left_anti").unionByName(changed)


def removed(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path"), "path", "left_anti")


def consistency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """check, n_bad: each check must count 0."""
    known = nodes.select("path")
    checks = {
        "edge_source_missing": edges.select(F.col("src").alias("path")).join(known, "path", "left_anti"),
        "edge_target_missing": edges.select(F.col("dst").alias("path")).join(known, "path", "left_anti"),
        "edge_repeated": edges.groupBy("src", "dst").count().filter("count > 1"),
        "edge_to_itself": edges.filter("src = dst"),
        "edge_kind_unknown": edges.filter(~F.col("kind").isin(*STRENGTH)),
        "edge_strength_wrong": edges.filter(F.col("strength") != strength_of(F.col("kind"))),
        "node_repeated": known.groupBy("path").count().filter("count > 1"),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
        out = one if out is None else out.unionByName(one)
    return out


def has_file(nodes: DataFrame, path) -> bool:
    return not nodes.filter(F.col("path") == F.lit(path)).isEmpty()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("in_degree"))

