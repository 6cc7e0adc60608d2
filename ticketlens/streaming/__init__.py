"""Streaming: intentionally empty.

The reference reads one file in batch and has no stream, watermark, window
or state (SURVEY section 2.8), so nothing here is built.  The library's
report functions take and return DataFrames; the grouped aggregations among
them (volume and delay-rate tables) also accept a streaming DataFrame, but
no streaming entry point is registered because the reference has none.
"""
