"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Every operator takes and returns DataFrames. Conventions that hold for all of them:

* a null text is an empty text; a null or repeated ``doc_id`` is carried through, each row is a document of its own;
* columns that an operator does not read may have any name, they are left behind or passed on untouched;
* an empty table gives an empty result of the same schema.
"""
