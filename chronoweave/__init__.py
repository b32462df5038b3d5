"""Timeline analytics on Spark: intervals, frames, speakers, transcripts, as DataFrames.

Every relation carries ``media_id`` and, where order matters, an explicit ``ord``.  Times are whole
milliseconds (bigint) from the start of the media; seconds appear at the edges only.
"""
