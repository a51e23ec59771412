"""Names, callables and comparison SQL of the corpus operators."""

from . import bpe, jaccard, language, mixing, neighbours, quality, simhash, substrings, suffixes, toxicity, tries, warc, whitening

MODULES = (bpe, jaccard, language, mixing, neighbours, quality, simhash, substrings, suffixes, toxicity, tries, warc, whitening)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
