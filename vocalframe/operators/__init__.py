"""DataFrame -> DataFrame operators: metrics, splits, pairing, numbering, permutations, runs,
labels, waveform and feature arrays, Arrow audio jobs, user models."""
