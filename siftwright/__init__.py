"""siftwright: curation, decontamination and evaluation of text corpora as Spark plans."""
