"""Table operators: packets, codes, channel, clusters, probes, statistics, sweeps."""
