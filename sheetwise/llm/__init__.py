"""Training-data operators: thirteen corpus-scale steps, each a Spark job over a `documents`-like table.

Nothing outside this subpackage imports it; `__spark_entry__` adds its queries only when it is present.
"""
