"""corpuskit: corpus cleaning, compound splitting, Unigram vocabularies and
masked-language-model data as Spark DataFrame jobs."""

__version__ = "0.1.0"
