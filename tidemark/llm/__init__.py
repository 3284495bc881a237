"""Operators that prepare the filing corpus for language-model training.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
