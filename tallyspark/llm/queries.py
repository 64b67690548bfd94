"""The queries of this package and, where SQL can express them, their DuckDB form."""

from __future__ import annotations

from . import alignment, bpe, jaccard, langid, lmscore, media, mixing, packing, pii, quality, spelling, substrings, toxicity

MODULES = (quality, packing, jaccard, pii, media, toxicity, substrings, lmscore, langid, mixing, spelling, bpe, alignment)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    named = {f"OP{k[2:].split('_')[0]}_SQL": k for k in queries()}
    return {named[k]: v for m in MODULES for k, v in vars(m).items() if k in named}
