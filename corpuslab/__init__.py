"""corpuslab: corpus analytics and training-data operators expressed as Spark plans."""
