"""Pipelines: a TOML text is checked, lowered to steps over a frame of reads, and run."""
