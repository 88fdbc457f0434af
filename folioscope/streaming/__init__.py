"""streaming of the document-revision engine."""
