"""Import resolution as joins: module index, Python imports and bindings, JavaScript specifiers."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import small

STDLIB = tuple(sorted(sys.stdlib_module_names))
INITIALS = r"(^|/)__init__\.py$"


def directory(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), "/")


def module_index(files: DataFrame, source_roots: tuple[str, ...] = ()) -> DataFrame:
    """module, path, source_root: one path for each dotted module of the Python files.

    A name counted from the project's root goes before one counted from a source root; then the first source
    root, then the first path.
    """
    python = files.filter(F.col("path").endswith(".py")).select("path")

    def named(df: DataFrame, root: str, place: int) -> DataFrame:
        relative = F.col("path") if not root else F.substring("path", len(root) + 2, 1 << 30)
        module = F.regexp_replace(F.regexp_replace(F.regexp_replace(relative, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
        rows = df if not root else df.filter(F.col("path").startswith(root + "/"))
        return rows.select(module.alias("module"), "path", F.lit(root).alias("source_root"), F.lit(place).alias("place"))

    every = named(python, "", 0)
    for i, root in enumerate(source_roots, 1):
        every = every.unionByName(named(python, root.strip("/"), i))
    first = F.row_number().over(Window.partitionBy("module").orderBy("place", "path"))
    return every.filter("module <> ''").withColumn("nth", first).filter("nth = 1").select("module", "path", "source_root")


def packages(files: DataFrame) -> DataFrame:
    """Directories with an __init__.py."""
    return files.filter(F.col("path").rlike(INITIALS)).select(directory(F.col("path")).alias("dir")).distinct()


def classified(imports: DataFrame, third_party: DataFrame | None = None, stdlib: tuple[str, ...] = STDLIB) -> DataFrame:
    """imports with root and status: stdlib, external or project (still to be resolved)."""
    root = F.substring_index("module", ".", 1)
    out = imports.withColumn("root", root).withColumn("status", F.when((F.col("level") == 0) & F.col("root").isin(*stdlib), "stdlib").otherwise("project"))
    if third_party is None:
        return out
    out = out.join(small(third_party.select(F.col("package").alias("root")).distinct().withColumn("external", F.lit(True))), "root", "left")
    return out.withColumn("status", F.when((F.col("status") == "project") & (F.col("level") == 0) & F.col("external"), "external").otherwise(F.col("status"))).drop("external")


def _keys(imports: DataFrame, files: DataFrame, source_roots: tuple[str, ...]) -> DataFrame:
    """imports with key (the module to look for) and fallback (the package where no name is a module)."""
    parts = F.split(directory(F.col("path")), "/")
    with_dir = imports.withColumn("dir", directory(F.col("path"))).join(small(packages(files).withColumn("is_package", F.lit(True))), "dir", "left")
    climb = F.greatest(F.col("level") - 1, F.lit(0)) + F.when((F.col("level") > 1) & F.col("is_package").isNull(), 1).otherwise(0)
    dirs = F.filter(parts, lambda p: p != "")
    base = F.when(F.size(dirs) >= climb, F.slice(dirs, 1, F.size(dirs) - climb))
    path = F.array_join(base, "/")
    for root in reversed(source_roots):
        root = root.strip("/")
        path = F.when(F.array_join(base, "/").startswith(root + "/"), F.substring(F.array_join(base, "/"), len(root) + 2, 1 << 30)).when(F.array_join(base, "/") == root, "").otherwise(path)
    with_base = with_dir.withColumn("base", F.regexp_replace(path, "/", "."))

    def below(name: Column) -> Column:
        return F.when(F.col("base") == "", name).otherwise(F.concat("base", F.lit("."), name))

    bare = (F.col("level") > 0) & (F.col("module") == "")
    key = F.when(F.col("level") == 0, F.col("module")).when(bare & (F.col("name") != "*"), below(F.col("name"))).when(bare, F.col("base")).otherwise(below(F.col("module")))
    return with_base.withColumn("key", key).withColumn("fallback", F.when(bare & (F.col("name") != "*"), F.col("base"))).drop("dir", "is_package", "base")


def resolved(imports: DataFrame, files: DataFrame, index: DataFrame, source_roots: tuple[str, ...] = (), third_party: DataFrame | None = None) -> DataFrame:
    """Python imports with status and resolved_path (null where nothing is found), and as_module: the name is a module.

    Of "from . import a, b" each name that is a module resolves to it; where none of them does, all stand for the
    package.  The index is joined by module; it is broadcast if its size allows.
    """
    python = classified(imports.filter(F.col("path").endswith(".py") | F.col("path").endswith(".pyi")), third_party)
    keyed = _keys(python, files, source_roots)
    lookup = index.select(F.col("module").alias("key"), F.col("path").alias("hit"))
    again = index.select(F.col("module").alias("fallback"), F.col("path").alias("package_hit"))
    wanted = F.when(F.col("status") == "project", F.col("key"))
    out = keyed.withColumn("key", wanted).join(small(lookup), "key", "left").join(small(again), "fallback", "left")
    any_hit = F.max(F.when(F.col("fallback").isNotNull(), F.col("hit").isNotNull())).over(Window.partitionBy("path", "statement"))
    path = F.when(F.col("fallback").isNull() | F.coalesce(any_hit, F.lit(False)), F.col("hit")).otherwise(F.col("package_hit"))
    out = out.withColumn("resolved_path", path).withColumn("as_module", (F.col("form") == "import") | (F.col("fallback").isNotNull() & F.col("hit").isNotNull()))
    return out.select("path", "statement", "form", "level", "module", "name", "alias", "line", "root", "status", "resolved_path", "as_module", "key", "fallback")


def _statement_targets(found: DataFrame) -> DataFrame:
    """src, statement, dst of resolved imports, with what package files import from elsewhere, one level deep."""
    direct = found.filter("resolved_path is not null").select(F.col("path").alias("src"), "statement", F.col("resolved_path").alias("dst"))
    reexported = found.filter((F.col("form") == "from") & F.col("resolved_path").isNotNull() & F.col("path").rlike(INITIALS)).select(F.col("path").alias("init"), F.col("resolved_path").alias("dst")).distinct()
    through = found.filter((F.col("form") == "from") & F.col("resolved_path").rlike(INITIALS)).select(F.col("path").alias("src"), "statement", F.col("resolved_path").alias("init")).distinct()
    return direct.unionByName(through.join(reexported, "init").select("src", "statement", "dst"))


def import_targets(found: DataFrame) -> DataFrame:
    """src, dst of resolved imports, with what package files import from elsewhere, one level deep."""
    return _statement_targets(found).select("src", "dst").distinct()


def import_edges(targets: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, kind of targets that are files, without edges of a file to itself."""
    known = files.select(F.col("path").alias("dst"))
    return targets.filter("src <> dst").join(known, "dst", "left_semi").select("src", "dst", F.lit("Import").alias("kind"))


def counters(found: DataFrame) -> DataFrame:
    """path, attempted, failed: every from-import, failed where it adds no new path to its file (standard and foreign
    ones too), and every name of other imports that is neither standard nor foreign, failed where nothing is found."""
    first = _statement_targets(found).groupBy("src", "dst").agg(F.min("statement").alias("statement"))
    fresh = first.select(F.col("src").alias("path"), "statement").distinct().withColumn("hit", F.lit(True))
    named = found.filter("form = 'from'").select("path", "statement").distinct().join(fresh, ["path", "statement"], "left").select("path", F.coalesce("hit", F.lit(False)).alias("hit"))
    bare = found.filter("form = 'import' and status = 'project'").select("path", F.col("resolved_path").isNotNull().alias("hit"))
    return named.unionByName(bare).groupBy("path").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(~F.col("hit")).alias("failed"))


def bindings(found: DataFrame) -> DataFrame:
    """path, local_name, resolved_path, imported_symbol (null where the name is a module)."""
    named = found.filter(F.col("resolved_path").isNotNull() & (F.col("name").isNull() | (F.col("name") != "*")))
    local = F.coalesce("alias", F.when(F.col("form") == "import", F.col("root")).otherwise(F.col("name")))
    return named.select("path", local.alias("local_name"), "resolved_path", F.when(~F.col("as_module"), F.col("name")).alias("imported_symbol")).distinct()


def lookup(index: DataFrame, module: str) -> DataFrame:
    """What a dotted module, its package, and modules below it are in the index."""
    return index.filter((F.col("module") == module) | F.col("module").startswith(module + "."))


def explained(found: DataFrame, path: str, module: str) -> DataFrame:
    """step, label, value: how imports of a module in a file were resolved, a row a step and an imported name."""
    one = found.filter((F.col("path") == path) & (F.col("module") == module))
    steps = {
        "statement": F.concat_ws(" ", "form", F.concat(F.repeat(F.lit("."), "level"), F.col("module")), F.coalesce("name", F.lit(""))), "root": F.col("root"), "status": F.col("status"),
        "key": F.col("key"), "fallback": F.col("fallback"), "resolved": F.col("resolved_path"), "binds": F.when(F.col("resolved_path").isNotNull(), F.when(F.col("as_module"), "module").otherwise("symbol")),
    }
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), v.cast("string").alias("value")) for i, (n, v) in enumerate(steps.items(), 1)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


# ---- JavaScript

JS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def normal_path(path: Column) -> Column:
    """A path without . and .. parts; null where it climbs over the root."""
    parts = F.split(path, "/")
    up = F.lit("..")

    def step(acc: Column, p: Column) -> Column:
        return F.when(acc.isNull() | (p == "") | (p == "."), acc).when(p == up, F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def js_candidates(target: Column) -> Column:
    """Paths to try for a target, in order: with an extension (for the one it has), as a folder, as it is."""
    stem = F.regexp_replace(target, r"(?<=[^/])\.[^./]*$", "")
    return F.array(*(F.concat(stem, F.lit("." + e)) for e in JS_EXTENSIONS), *(F.concat_ws("/", F.when(target != "", target), F.lit("index." + e)) for e in JS_EXTENSIONS), target)


def js_resolved(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, base_url: str = "") -> DataFrame:
    """path, statement, module, resolved_path of JavaScript specifiers; bare ones resolve by aliases alone.

    aliases has pattern (exact, or ending in /*) and target; the longest pattern wins.  Alias tables are a
    project's configuration: their size is checked before they are broadcast into the prefix join.
    """
    rows = imports.filter(F.col("path").rlike(r"\.(js|mjs|cjs|jsx|ts|tsx)$")).select("path", "statement", "module").distinct()
    relative = rows.filter(F.col("module").startswith(".")).withColumn("target", normal_path(F.concat_ws("/", directory(F.col("path")), F.col("module"))))
    rooted = rows.filter(F.col("module").startswith("/")).withColumn("target", normal_path(F.col("module")))
    targets = relative.unionByName(rooted).withColumn("weight", F.lit(0))
    if aliases is not None:
        stem = F.regexp_replace("pattern", r"/\*$", "")
        wild = F.col("pattern").endswith("/*")
        hit = F.when(wild, F.col("module").startswith(stem)).otherwise(F.col("module") == F.col("pattern"))
        rest = F.regexp_replace(F.expr("substring(module, length(regexp_replace(pattern, '/[*]$', '')) + 1)"), "^/+", "")
        to = F.when(wild, F.concat_ws("/", F.regexp_replace("target", r"/\*$", ""), rest)).otherwise(F.col("target"))
        bare = rows.filter(~F.col("module").rlike(r"^[./]")).join(small(aliases), hit)
        bare = bare.filter(~wild | F.col("target").endswith("/*")).select("path", "statement", "module", normal_path(F.concat_ws("/", F.lit(base_url), to)).alias("target"), F.length("pattern").alias("weight"))
        targets = targets.unionByName(bare)
    tried = targets.filter("target is not null").select("path", "statement", "module", "weight", F.posexplode(js_candidates(F.col("target"))).alias("place", "candidate"))
    hits = tried.join(files.select(F.col("path").alias("candidate")), "candidate")
    return hits.groupBy("path", "statement", "module").agg(F.min_by("candidate", F.struct(-F.col("weight"), "place")).alias("resolved_path"))


def js_module_index(files: DataFrame) -> DataFrame:
    """module, path of JavaScript files without extension; index files stand for their folder too."""
    js = files.filter(F.col("path").rlike(r"\.(js|mjs|cjs|jsx|ts|tsx)$")).select(F.regexp_replace("path", r"\.[^.]+$", "").alias("module"), "path")
    folders = js.filter(F.col("module").rlike("/index$")).select(F.regexp_replace("module", "/index$", "").alias("module"), "path")
    return js.unionByName(folders).groupBy("module").agg(F.min("path").alias("path"))


def package_of(specifier: Column) -> Column:
    """The package that a bare specifier names: two parts with a scope, else one."""
    bare = F.regexp_replace(specifier, "^node:", "")
    return F.when(bare.startswith("@"), F.substring_index(bare, "/", 2)).otherwise(F.substring_index(bare, "/", 1))


def js_external(imports: DataFrame, known: DataFrame) -> DataFrame:
    """Bare specifiers of known packages, or of a known scope."""
    bare = imports.filter(~F.col("module").rlike(r"^[./]")).withColumn("package", package_of(F.col("module")))
    names = known.select("package").distinct()
    return bare.join(names, "package", "left_semi").unionByName(bare.join(names, "package", "left_anti").withColumn("scope", F.substring_index("package", "/", 1)).join(names.withColumnRenamed("package", "scope"), "scope", "left_semi").drop("scope"))
