"""Readers and writers: corpora, chunk tables, samples, prompts, run logs, reports."""
