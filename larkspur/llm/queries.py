"""The registered queries of this subpackage and their SQL."""

from . import (
    bpe,
    chunk_dedup,
    decontamination,
    fill_in_middle,
    licenses,
    line_dedup,
    packing,
    piecewise_hash,
    quality,
    sharding,
    simhash_dedup,
    toxicity,
    whitening,
)

_MODULES = (simhash_dedup, licenses, toxicity, line_dedup, chunk_dedup, bpe, sharding, quality, piecewise_hash, decontamination, whitening, fill_in_middle, packing)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
