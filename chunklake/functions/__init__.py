"""Column functions: paths, sizes, times, codecs, chunking."""
