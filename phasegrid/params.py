"""Default parameters shared by the operators."""

# Window cycles, read length of interest, positional tolerance,
# contig stride and overlap.
CYCLE = 9
DICER = 21
DRIFT = 2
STRIDE = 5000
OVERLAP = 250

CONTIG_KEYS = ["library", "chr", "tile"]
