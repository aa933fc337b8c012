"""Readers of sequencing files into frames of reads, and writers."""
