"""caseworks: Spark jobs for document-centred operations data."""
