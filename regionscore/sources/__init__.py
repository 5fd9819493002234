"""Readers: files to typed DataFrames, with what they reject kept beside what they accept."""
