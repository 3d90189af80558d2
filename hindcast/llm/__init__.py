"""Training-data operators.

Nothing outside this package imports it; its queries live in
``hindcast.llm.queries`` and are added by ``__spark_entry__.py`` only when the
package can be imported.
"""
