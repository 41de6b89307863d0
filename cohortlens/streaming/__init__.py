"""Incremental scoring of arriving files (Structured Streaming).

The analysed dashboards score students uploaded as files; here the same
batch-scoring expressions run over a file stream: every new file in the source
folder is scored once (exactly once through the query checkpoint) and appended
to the sink.  No state is kept between micro-batches.
"""

from cohortlens.streaming.scoring import score_stream  # noqa: F401
