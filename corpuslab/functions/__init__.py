"""Column functions: normalisation, tokens, segmentation, classification, hashing."""
