"""Compositions of the operators: the observatory domain and its end-to-end run, the
medallion stages, catalog and documents, generators, gold tables, and the queries
(with their independent SQL) that exercise every operator on the shared tables."""
