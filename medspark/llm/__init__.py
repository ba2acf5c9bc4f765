"""Training-data operators: secrets, near-duplicates, decontamination, sharding,
quality rules, token files, licences, language-model scores, BPE and repeated
passages.  Nothing else in the library imports this package; its queries are in
``medspark.llm.queries``.

Shared conventions (each operator's docstring states its own cases too):

* a NULL text has no words and behaves like an empty one;
* only the named id and text columns are read, so extra columns, whatever they
  are called, can not clash with internal names;
* results never depend on how rows are dealt to partitions.
"""
