"""Access paths: secondary indexes, vector indexes and columnar snapshots."""
