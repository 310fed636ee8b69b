"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Shared conventions, unless an operator's docstring says otherwise:

* null texts are treated as empty texts, and whole texts are always processed;
* rows are processed one by one, so repeated rows (also repeated doc_ids) each yield their own result;
* inputs may carry any further columns: operators select the columns they need first and return only theirs;
* empty tables yield empty results with the same schema.
"""
