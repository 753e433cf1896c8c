"""Training-data operators: operators over `documents`, `pages`, `benchmark`, `labels` and `conversations`.

Nothing outside this package (and `corpus_pipeline.py`) imports it.  Each module holds one
operator with a general interface; `queries.py` holds the thin registered queries.
"""
