"""Streaming: tree labels are a stateless projection, so they apply to a
streaming DataFrame unchanged; leaf x class counts are a plain streaming
aggregation."""

from .labels import label_counts, label_counts_stream, label_stream

__all__ = ["label_counts", "label_counts_stream", "label_stream"]
