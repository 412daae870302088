"""Spark jobs over time-stamped transcripts, speech segments and subtitles."""
