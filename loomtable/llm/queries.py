"""Queries of this subpackage for the driver: one per operator, and the pipeline's rows."""

from __future__ import annotations

import importlib

#: Query name, module, function.
NAMES = [
    ("op1_warc", "archive", "op1"),
    ("op2_licenses", "licenses", "op2"),
    ("op3_url_filter", "urlfilter", "op3"),
    ("op4_decontamination", "decontam", "op4"),
    ("op5_bpe", "bpe", "op5"),
    ("op6_chat", "chat", "op6"),
    ("op7_neardup", "neardup", "op7"),
    ("op8_secrets", "secretscan", "op8"),
    ("op9_quality", "quality", "op9"),
    ("op10_ann", "ann", "op10"),
]


def queries() -> dict:
    return {name: _lazy(module, function) for name, module, function in NAMES}


def _lazy(module: str, function: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"loomtable.llm.{module}"), function)(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    from loomtable.llm.oracles import SQL

    return dict(SQL)
