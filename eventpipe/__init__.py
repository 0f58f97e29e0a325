"""eventpipe: page snapshots and message streams in, deduplicated typed event tables out.

Every operator is a function from DataFrames to DataFrames built on the
DataFrame / SQL API, so Catalyst plans and the same code runs in batch and in
Structured Streaming (``foreachBatch``) alike.
"""

__version__ = "0.1.0"
