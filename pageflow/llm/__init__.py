"""Operators that prepare recognised text for language-model training.

Nothing else in the library imports this folder. Records are the library's own: a *file* is
one document of a *folder* with its recognised ``text`` (``file_id``, ``folder``, ``text``).
"""
