"""Readers of sheets, questions, documents and results, and writers of reports and indexes."""
