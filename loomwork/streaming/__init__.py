"""Streams of responses and events. The batch operators have no stream of their own; these keep their results up to date."""
