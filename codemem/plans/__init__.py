"""Multi-step jobs: the store, the ingest pipeline and the registered queries."""
