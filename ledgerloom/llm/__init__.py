"""Training-data operators: one module per operator, queries in :mod:`ledgerloom.llm.queries`."""
