"""DataFrame operators: rows and chunks, filters, analytics, retrieval, context, evaluation, reports."""
