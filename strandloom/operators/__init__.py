"""The steps of a pipeline.  Each is a function of a frame of reads and of its parameters that returns a frame."""
