"""Frame indexes, chunks, pixels, folds, audio and timelines over containers."""
