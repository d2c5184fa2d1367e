"""Statements and the DataFrame plans they become."""
