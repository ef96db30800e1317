"""The queries and SQL of this subpackage."""

from __future__ import annotations

from . import chat, decision_list, decontam, dom_crf, jaccard, linededup, packing, pii, rans, string_kernel

MODULES = (rans, decision_list, packing, decontam, pii, chat, string_kernel, dom_crf, linededup, jaccard)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
