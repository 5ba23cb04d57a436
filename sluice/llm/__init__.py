"""Operators of a training-data pipeline: filtering, de-duplication, mixing,
archiving, tokenising and sanitising of text collections.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
