"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import language, licences, linededup, mixing, packing, quality, resample, secrets, simhash, spelling, substrings, topk, urlfilter

MODULES = (secrets, linededup, packing, urlfilter, mixing, language, simhash, licences, topk, quality, resample, substrings, spelling)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
