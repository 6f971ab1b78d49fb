"""Operators that prepare code and documents as training text.

Nothing outside this subpackage imports it; its queries are registered by
``__spark_entry__`` only when it can be imported.
"""
