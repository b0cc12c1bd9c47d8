"""Operators for training-data pipelines: one module per operator, queries in ``queries``.

Nothing outside this package imports it. Conventions shared by all operators:

* A null text counts as an empty text; a null id is kept and sorts before every other id.
* Every input row counts by itself: repeated rows give repeated results.
* Only the named columns are read; other columns, whatever their names, pass through or are ignored.
* Tables that are read twice are written to the folder named by ``spark.checkpoint.dir``.
"""
