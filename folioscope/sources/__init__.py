"""sources of the document-revision engine."""
