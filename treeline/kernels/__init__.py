"""Numpy kernels for the steps that are sequential by nature: pruning, hidden Markov chains, tree surgery, alignment."""
