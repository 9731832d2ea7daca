"""All queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from . import chat_quotes, decontaminate, html_text, mixing, pii, quality, simhash, token_files, toxicity, url_filter

MODULES = (decontaminate, mixing, simhash, toxicity, html_text, pii, quality, url_filter, chat_quotes, token_files)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
