"""Embedding-table analytics on Spark DataFrames.

The names that most programs need: models, readers and the commonest operators.
"""

from wordloom.model import EmbeddingModel, Subwords, VocabKind
from wordloom.operators.lookup import lookup_batch, lookup_distinct
from wordloom.operators.similarity import analogy, embedding_similarity, word_similarity
from wordloom.sources.fasttext import read_fasttext
from wordloom.sources.native import QuantizedModel, mmap_embeddings, read_embeddings, read_metadata
from wordloom.sources.text import read_text, read_text_dims
from wordloom.sources.word2vec import read_word2vec_binary

__all__ = [
    "EmbeddingModel",
    "QuantizedModel",
    "Subwords",
    "VocabKind",
    "analogy",
    "embedding_similarity",
    "lookup_batch",
    "lookup_distinct",
    "mmap_embeddings",
    "read_embeddings",
    "read_fasttext",
    "read_metadata",
    "read_text",
    "read_text_dims",
    "read_word2vec_binary",
    "word_similarity",
]
