"""Training-data operators over documents, pages and benchmarks.

Nothing outside this subpackage imports it; see ``queries.py`` for the thin
queries registered by the repository's entry module.
"""
