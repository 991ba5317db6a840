"""Chunk iteration: lambdas over chunks in batch, and (as an extension) over a landing folder of chunk files."""
