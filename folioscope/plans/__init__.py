"""plans of the document-revision engine."""
