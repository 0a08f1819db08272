"""tessera: hypothesis validation over text corpora as Spark DataFrame plans."""
