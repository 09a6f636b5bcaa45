"""Operators for preparing language-model training data.

Ten self-contained operators over ``documents``, ``embeddings``, ``benchmark``,
``labels`` and ``conversations``.  Nothing else in the library imports this
subpackage; ``strandlake.llm.queries`` holds the thin ``opN_*`` queries.
"""
