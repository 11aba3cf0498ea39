"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import align, bitpack, bpe, chat, collocations, licenses, lm, mixing, neardup, packing, quality, toxicity, vectors

MODULES = (mixing, quality, neardup, packing, bitpack, toxicity, chat, vectors, lm, licenses, bpe, align, collocations)


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out |= getattr(m, "ORACLES", {})
    return out
