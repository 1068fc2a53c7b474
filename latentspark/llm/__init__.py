"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; the registries in
``latentspark.llm.queries`` are added by ``__spark_entry__.py`` when the
subpackage is installed.
"""
