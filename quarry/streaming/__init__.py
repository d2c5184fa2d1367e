"""Followers of the commit log by Structured Streaming."""
