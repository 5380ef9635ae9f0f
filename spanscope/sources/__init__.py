"""Tables to start from: genomes, loci, generated sequences, event tables."""
