"""Operators for preparing training text at scale.

Thirteen operators, one module each; ``queries`` registers one query per operator
(``corpus_pipeline.py`` at the repository top chains five of them). Nothing else in
the library imports this package.

Conventions shared by all modules:

* a null text has no words and no bytes; a null id or source is a value like any other;
* a row is a document: repeated rows are separate documents, and rows that agree in id and
  text always get the same answer, so no row number is ever needed. Internally a document is
  addressed by its id and a 64-bit hash of its text;
* an empty table gives an empty result with the same columns;
* further columns of the input are never read, whatever their names; where an operator hands
  documents on, they come through unchanged.
"""
