"""Incremental refresh of the reporting views from a stream of claim files."""

from claimlens.streaming.views import (  # noqa: F401
    STREAMED_VIEWS,
    read_claims_stream,
    read_view,
    start_view_refresh,
)
