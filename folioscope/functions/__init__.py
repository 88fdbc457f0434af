"""functions of the document-revision engine."""
