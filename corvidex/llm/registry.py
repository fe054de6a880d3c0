"""All queries of this subpackage and their SQL, the pipeline included."""

from __future__ import annotations

import corpus_pipeline
from corvidex.llm import aligning, bpe, chat, decontaminate, exactdedup, langid, minhash, quality, rangecoder, ranked, sharding, tokenfiles, warc

_MODULES = (bpe, tokenfiles, minhash, warc, langid, decontaminate, rangecoder, sharding, chat, quality, exactdedup, ranked, aligning)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
