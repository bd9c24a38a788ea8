"""Writers: files, documents and catalog tables."""
