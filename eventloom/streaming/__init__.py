"""The pipeline as streaming queries.

Three stages joined by topics, each with its own checkpoint: `ingest` accepts
request bodies, `enrichment` validates and enriches, `storage` keeps events,
rollups and the live feed. Dead letters have a stage of their own.
"""
