"""The repository map: ranked files and the tree of folders as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import in_degree
from .rank import stars, top_ranked


def map_lines(ranks: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """path, rank, line for the k highest ranks."""
    top = top_ranked(stars(ranks), k).join(in_degree(edges), "path", "left")
    line = F.format_string("%s %s (rank %.3f, used by %d)", "stars", "path", "rank", F.coalesce("in_degree", F.lit(0)))
    return top.select("path", "rank", line.alias("line"))


def directory_entries(files: DataFrame) -> DataFrame:
    """depth, parent, name, is_dir: each entry once."""
    parts = F.split("path", "/")
    rows = files.select(parts.alias("parts"), F.posexplode(parts).alias("depth", "name"))
    return rows.select("depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("parent"), "name", (F.col("depth") < F.size("parts") - 1).alias("is_dir")).distinct()


def tree(entries: DataFrame) -> str:
    """Indented text, folders before files, by name."""
    below: dict[str, list[tuple[bool, str]]] = {}
    for r in entries.collect():
        below.setdefault(r.parent, []).append((not r.is_dir, r.name))
    lines: list[str] = []

    def walk(parent: str, depth: int) -> None:
        for is_file, name in sorted(below.get(parent, [])):
            lines.append("  " * depth + name + ("" if is_file else "/"))
            if not is_file:
                walk(f"{parent}/{name}" if parent else name, depth + 1)

    walk("", 0)
    return "\n".join(lines)


def repository_map(files: DataFrame, ranks: DataFrame, edges: DataFrame, k: int = 50) -> str:
    ranked = map_lines(ranks, edges, k).orderBy(F.desc("rank"), "path").collect()
    head = f"# Repository map: {files.count()} files, the first {len(ranked)} by rank"
    return "\n".join([head, "", *(r.line for r in ranked), "", "# Tree", tree(directory_entries(files))]) + "\n"
