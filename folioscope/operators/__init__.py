"""operators of the document-revision engine."""
