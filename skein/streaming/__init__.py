"""Streams: windows over event time, duplicates within a watermark, sessions with a limit."""
