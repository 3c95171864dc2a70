"""Corpus readers and text sinks for timelines, transcripts, scripts, plans and report stores."""
