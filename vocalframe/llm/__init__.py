"""Training-data operators: near-duplicate joins, decontamination, URL rules,
fingerprints, WARC, quality and language models, mixing, chat threads, token files.

Each operator module has a general interface; ``queries`` derives the digest
columns of the registered ``opN_*`` queries from it.
"""
