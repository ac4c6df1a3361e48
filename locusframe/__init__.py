"""locusframe: genomic and omics analytics expressed as Spark DataFrame plans."""
