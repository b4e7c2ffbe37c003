"""Third-party packages and source roots from project files, as relations."""

from __future__ import annotations

import fnmatch
import json
import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Import names that differ from the name of the distribution.
IMPORT_NAMES = {
    "beautifulsoup4": "bs4", "opencv-python": "cv2", "opencv-python-headless": "cv2", "pillow": "PIL", "psycopg2-binary": "psycopg2", "pymongo": "pymongo",
    "python-dateutil": "dateutil", "python-dotenv": "dotenv", "python-jose": "jose", "python-multipart": "multipart", "pyyaml": "yaml", "scikit-learn": "sklearn",
}
COMMON = tuple(sorted("cv2 django fastapi flask itsdangerous jinja2 matplotlib numpy pandas PIL pydantic pytest pytz requests scipy sklearn sqlalchemy starlette tensorflow torch uvicorn werkzeug".split()))
NODE_BUILTINS = tuple(sorted("zlib worker_threads vm v8 util url tty tls timers string_decoder stream readline querystring punycode perf_hooks path os net inspector https http fs events domain dns dgram crypto cluster child_process buffer async_hooks assert".split()))


def import_names(requirement: Column) -> Column:
    """Likely import names of a requirement, as an array: the known one, with underscores, the first part."""
    name = F.lower(F.trim(F.regexp_extract(F.trim(requirement), r"^([A-Za-z0-9._-]*)", 1)))
    known = F.lit(None).cast("string")
    for dist, imported in IMPORT_NAMES.items():
        known = F.when(name == dist, imported).otherwise(known)
    found = F.array(known, F.translate(name, "-", "_"), F.regexp_extract(name, r"^([^-_]*)", 1))
    return F.filter(F.array_distinct(found), lambda x: x.isNotNull() & (x != ""))


def requirements(files: DataFrame) -> DataFrame:
    """package, from requirements files (path, content): at the root, in requirements/, or one folder down."""
    named = files.filter(F.col("path").rlike(r"^([^/]+/)?requirements\.txt$|^requirements/[^/]+\.txt$"))
    lines = named.select(F.explode(F.split("content", r"\r?\n")).alias("line")).select(F.trim(F.substring_index("line", "#", 1)).alias("line"))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("-")).select(F.explode(import_names(F.col("line"))).alias("package")).distinct()


def _toml(text: str | None) -> dict:
    try:
        return tomllib.loads(text or "")
    except (tomllib.TOMLDecodeError, TypeError):
        return {}


def _declared(text: str | None) -> list[str]:
    data = _toml(text)
    poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
    return [*(d for d in data.get("project", {}).get("dependencies", []) if isinstance(d, str)), *(k for k in poetry if k.lower() != "python")]


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    """package, from pyproject.toml at the root or one folder down; a file that is no TOML gives none."""
    declared = F.udf(_declared, "array<string>", useArrow=True)
    named = files.filter(F.col("path").rlike(r"^([^/]+/)?pyproject\.toml$"))
    return named.select(F.explode(declared("content")).alias("requirement")).select(F.explode(import_names(F.col("requirement"))).alias("package")).distinct()


def third_party(files: DataFrame) -> DataFrame:
    """package: the common ones and all that project files name."""
    spark = files.sparkSession
    common = spark.createDataFrame([(c,) for c in COMMON], "package string")
    return common.unionByName(requirements(files)).unionByName(pyproject_dependencies(files)).distinct()


def node_packages(files: DataFrame) -> DataFrame:
    """package: dependencies of every package.json, the scopes of scoped ones, and what the runtime brings."""
    spark = files.sparkSession
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>"
    parsed = files.filter(F.col("path").rlike(r"(^|/)package\.json$") & ~F.col("path").contains("node_modules/")).select(F.from_json("content", kind).alias("j"))
    keys = F.concat(*(F.coalesce(F.map_keys(f"j.{k}"), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")))
    named = parsed.select(F.explode(keys).alias("package"))
    scopes = named.filter(F.col("package").startswith("@")).select(F.substring_index("package", "/", 1).alias("package"))
    return named.unionByName(scopes).unionByName(spark.createDataFrame([(b,) for b in NODE_BUILTINS], "package string")).distinct()


def _without_comments(text: str) -> str:
    """JSON with comments and trailing commas, as configuration files have them."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 2 if c == "\\" else 1
            quoted = c != '"' or out[-1] != '"'
            continue
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else len(text)
        else:
            quoted = c == '"'
            if c in "}]" and "".join(out).rstrip().endswith(","):
                out = ["".join(out).rstrip()[:-1]]
            out.append(c)
            i += 1
    return "".join(out)


def path_aliases(configs: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """(base folder, (pattern, target) pairs) of the first configuration that parses, tsconfig before jsconfig."""
    for _, text in sorted((c for c in configs if c[0] in ("tsconfig.json", "jsconfig.json")), reverse=True):
        try:
            options = json.loads(_without_comments(text)).get("compilerOptions", {})
        except (json.JSONDecodeError, AttributeError):
            continue
        base = (options.get("baseUrl") or "").strip("./")
        return base, [(p, t) for p, targets in (options.get("paths") or {}).items() for t in targets]
    return "", []


def declared_roots(pyproject: str | None) -> list[str]:
    """Source roots that a pyproject.toml declares: Hatch, then Setuptools, then Poetry."""
    tool = _toml(pyproject).get("tool", {})
    hatch = tool.get("hatch", {}).get("build", {}).get("targets", {}).get("wheel", {}).get("packages", [])
    found = [p.rsplit("/", 1)[0] for p in hatch if "/" in p]
    if not found:
        setup = tool.get("setuptools", {})
        dirs = setup.get("package-dir", {})
        # A package's own folder is below its root as deep as its name is.
        found = [v if not k else "/".join(v.split("/")[: -len(k.split("."))]) for k, v in dirs.items() if isinstance(v, str)] if isinstance(dirs, dict) else []
        packages = setup.get("packages", {})
        if not found and isinstance(packages, dict):
            found = list(packages.get("find", {}).get("where", []))
    if not found:
        found = [p["from"] for p in tool.get("poetry", {}).get("packages", []) if isinstance(p, dict) and "from" in p]
    return list(dict.fromkeys(f.strip("./") for f in found if f.strip("./")))


def workspace_members(pyproject: str | None) -> list[str]:
    """Globs of a workspace's members."""
    return list(_toml(pyproject).get("tool", {}).get("uv", {}).get("workspace", {}).get("members", []))


def source_roots(files: DataFrame) -> list[str]:
    """Source roots: declared ones, of workspace members too, else src, lib or source, else folders that hold packages.

    Reads only folders and project files; these lists are short.
    """
    configs = {r.path: r.content for r in files.filter(F.col("path").rlike(r"(^|/)pyproject\.toml$")).select("path", "content").collect()}
    root = configs.get("pyproject.toml")
    found = declared_roots(root)
    for glob in workspace_members(root):
        for path in sorted(configs):
            folder = path.rpartition("/")[0]
            if folder and fnmatch.fnmatch(folder, glob):
                inner = declared_roots(configs[path])
                found += [f"{folder}/{r}" for r in inner] or [f"{folder}/src"]
    python = files.filter(F.col("path").endswith(".py"))
    parts = F.split("path", "/")
    tops = python.filter(F.size(parts) > 1).groupBy(parts[0].alias("dir")).agg(
        F.max((F.size(parts) == 2) & F.col("path").endswith("/__init__.py")).alias("is_package"), F.max((F.size(parts) == 3) & F.col("path").endswith("/__init__.py")).alias("has_package")
    )
    if found:
        nested = {r.d for r in python.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("d")).filter(F.col("d").isin(*found)).distinct().collect()}
        kept = [f for f in dict.fromkeys(found) if f in nested]
        if kept:
            return kept
    rows = sorted(tops.collect(), key=lambda r: r.dir)
    for name in ("src", "lib", "source"):
        if any(r.dir == name and not r.is_package for r in rows):
            return [name]
    holding = [r.dir for r in rows if not r.is_package and r.has_package]
    return holding or [r.dir for r in rows if not r.is_package and r.dir not in ("tests", "test", "docs", "examples", "scripts")]
