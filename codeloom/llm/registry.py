"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("chunking", "toxicity", "bpe", "superminhash", "decontamination", "repeats", "secrets", "langid", "warc", "transcripts")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__package__}.{m}"), "ORACLE_SQL", {}).items()}
