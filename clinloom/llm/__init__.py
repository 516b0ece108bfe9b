"""Training-data operators; each registers one query through :mod:`clinloom.llm.catalog`."""
