"""Queries and oracle SQL of every training-data operator."""

from __future__ import annotations

from pagefold.llm import bpe, chat, decontaminate, divergence, htmltext, licences, media, pii, quality, runs, simjoin, tokenfiles, toxicity

MODULES = (chat, pii, simjoin, toxicity, decontaminate, bpe, licences, media, tokenfiles, htmltext, runs, quality, divergence)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
