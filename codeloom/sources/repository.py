"""Repositories as relations: scan with ignore rules, reading, and checked writes."""

from __future__ import annotations

import os
import re
import shutil
import time
import tomllib
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import js_source, python_source
from ..schemas import LANGUAGE_OF

IGNORED_DIRS = ("__pycache__", "node_modules", ".venv", "venv", "build", "dist", "target", ".tox")


def ignore_list(text: str | None) -> tuple[str, ...]:
    """The default names and those of an ignore file, whose comments begin with #."""
    own = [x.strip() for x in (text or "").splitlines()]
    return tuple(dict.fromkeys([*IGNORED_DIRS, *(x.rstrip("/") for x in own if x and not x.startswith("#"))]))


def ignore_pattern(rule: str, base: str = "") -> tuple[str, bool] | None:
    """(regular expression on a relative path, whether it takes paths back in) of one line of a .gitignore in base."""
    rule = rule.rstrip("\r\n")
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored = "/" in rule
    out, i, rule = "", 0, rule.lstrip("/")
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            end = rule.index("]", i + 1)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    prefix = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    return f"^{prefix}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", negated


def not_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches a path decides."""
    ignored = F.lit(False)
    for pattern, negated in rules:
        ignored = F.when(path.rlike(pattern), not negated).otherwise(ignored)
    return ~ignored


def scan(paths: DataFrame, ignored_dirs: tuple[str, ...] = IGNORED_DIRS, rules: list[tuple[str, bool]] | None = None, tracked: DataFrame | None = None) -> DataFrame:
    """Relative paths that count: outside of .git and ignored folders, not ignored by rules or tracked all the same."""
    parts = F.split("path", "/")
    wanted = paths.filter(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(d) for d in (".git", *ignored_dirs)))))
    kept = wanted.filter(not_ignored(F.col("path"), rules)) if rules else wanted
    if tracked is None:
        return kept
    return kept.unionByName(wanted.join(tracked.select("path"), "path", "left_semi")).dropDuplicates(["path"])


#: The file of a project's own settings.
CONFIG = ".codeloom.toml"


def configured_roots(root: str, name: str = CONFIG) -> tuple[str, ...] | None:
    """Source roots that the project's settings name, under [project]; null where there are none, or no valid file."""
    try:
        found = tomllib.loads((Path(root) / name).read_text()).get("project", {}).get("source_roots")
    except (OSError, tomllib.TOMLDecodeError, AttributeError):
        return None
    return tuple(str(f).strip("./") for f in found) if isinstance(found, list) and found else None


def outer_rules(base: Path) -> list[tuple[str, bool]]:
    """Ignore rules from outside of a folder: the user's own, those of the folders above it within one work tree, and its excludes."""
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "git" / "ignore"
    out = [r for x in _lines(home) if (r := ignore_pattern(x))]
    tree = next((f for f in (base, *base.parents) if (f / ".git").exists()), None)
    if tree is None:
        return out
    for folder in [tree, *reversed([f for f in base.parents if tree in f.parents])] if tree != base else []:
        own = base.relative_to(folder).as_posix()
        for line in _lines(folder / ".gitignore"):
            rule = line.strip().removeprefix("!").lstrip("/")
            if "/" not in rule.rstrip("/"):
                anchored = line.strip().removeprefix("!").startswith("/")
                out += [r for r in [ignore_pattern(line)] if r and not anchored]
            elif rule.startswith(own + "/"):
                out += [r for r in [ignore_pattern(("!" if line.startswith("!") else "") + "/" + rule[len(own) + 1 :])] if r]
    if tree == base:
        out += [r for x in _lines(base / ".git" / "info" / "exclude") if (r := ignore_pattern(x))]
    return out


def _lines(path: Path) -> list[str]:
    try:
        return path.read_text(errors="replace").split("\n")
    except OSError:
        return []


def read_repository(spark: SparkSession, root: str, ignored_dirs: tuple[str, ...] = IGNORED_DIRS, tracked: DataFrame | None = None) -> DataFrame:
    """path (relative), content of the text files under root; files that aren't UTF-8 are left out.

    The driver lists names alone (Spark's own file sources skip names that begin with . or _, and empty files);
    what passes the rules is read by the executors, to whom root must be visible.  A query listener sees how many
    files there are and how many were dropped, under the name repository.
    """
    base = Path(root).resolve()
    names, rules = [], outer_rules(base)
    for folder, inner, files in os.walk(base):
        inner[:] = sorted(d for d in inner if d != ".git" and d not in ignored_dirs)
        below = Path(folder).relative_to(base).as_posix().removeprefix(".")
        names += [f"{below}/{f}" if below else f for f in files]
        if ".gitignore" in files:
            rules += [r for x in (Path(folder) / ".gitignore").read_text(errors="replace").split("\n") if (r := ignore_pattern(x, below))]
    paths = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names) // 64, spark.sparkContext.defaultParallelism * 8)))

    def stage(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                text = _read_text(base / path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], names=["path", "content"])

    found = scan(paths, ignored_dirs, rules, tracked).select("path").mapInArrow(stage, "path string, content string")
    counted = found.observe("repository", F.count(F.lit(1)).alias("files"), F.count_if(F.col("content").isNull()).alias("dropped"))
    return counted.filter("content is not null")


def _read_text(path: Path, tries: int = 3, pause: float = 0.1) -> str | None:
    """A file's text, after some tries; null where it is gone, can't be read or isn't UTF-8."""
    for left in reversed(range(tries)):
        try:
            return path.read_bytes().decode()
        except UnicodeDecodeError:
            return None
        except OSError:
            if left:
                time.sleep(pause)
    return None


def known_files(files: DataFrame) -> DataFrame:
    """Files of a known language."""
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(LANGUAGE_OF) + r")$"))


def inside(root: str, path: str) -> Path:
    """The absolute path; one that leaves root is an error."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if base != full and base not in full.parents:
        raise ValueError(f"{path} is outside of {root}")
    return full


def read_file(root: str, path: str) -> str:
    return inside(root, path).read_text()


def list_directory(root: str, path: str = ".") -> list[str]:
    return sorted(p.name + "/" * p.is_dir() for p in inside(root, path).iterdir())


def write_file(root: str, path: str, content: str) -> Path:
    """Writes a text whose syntax is right, with the old one kept beside it under the time."""
    full = inside(root, path)
    language = LANGUAGE_OF.get(PurePosixPath(path).suffix.lstrip(".").lower())
    valid, line, message = python_source.check_syntax(content) if language == "python" else js_source.check_syntax(content) if language and language != "rust" else (True, None, None)
    if not valid:
        raise ValueError(f"{path}:{line}: {message}")
    if full.exists():
        shutil.copy2(full, full.with_name(f"{full.name}.{time.strftime('%Y%m%d-%H%M%S')}.bak"))
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(content)
    return full


def write_map(root: str, path: str, text: str) -> Path:
    full = inside(root, path)
    full.write_text(text)
    return full
