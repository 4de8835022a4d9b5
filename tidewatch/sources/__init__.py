"""Readers and writers: webhook, payment and change streams, line files, topic dumps, sinks."""
