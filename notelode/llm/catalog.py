"""Queries of this subpackage and their SQL counterparts."""

from . import chat, collocations, decontaminate, embedding_dedup, near_dup, packing, pieces, pii, quality, runs, toxicity, url_rules, warc

MODULES = (toxicity, near_dup, decontaminate, pii, chat, quality, embedding_dedup, pieces, url_rules, warc, collocations, runs, packing)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
