"""Readers and writers: packets, strand text files, FASTQ."""
