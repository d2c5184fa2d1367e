"""Where tables live: files, the commit log, the catalog and the versioned store."""
