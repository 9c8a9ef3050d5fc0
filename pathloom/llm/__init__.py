"""Operators for large training-data pipelines over text, one module each.

Nothing else in the library imports this subpackage.  Common rules:

* operators read only the columns they name (``doc_id``, ``text`` ...); other
  columns, whatever they are called, are ignored or handed through;
* a null text counts as the empty text, and a null id is an ordinary value;
* state that must outlive a stage goes to ``spark.checkpoint.dir``.
"""
