"""Training-data operators: cleaning, de-duplication, scoring and tokenizing of text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator; `queries` registers
one query per operator over the driver's tables.
"""
