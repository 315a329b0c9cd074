"""All queries of this package."""

from girderframe.llm import decontamination, divergence, html_text, licenses, mixing, ngram_join, pii, quality_model, spelling, suffix_dedup, toxicity, url_filter, vector_neighbours
from girderframe.llm.common import Query

__all__ = ["QUERIES", "Query"]

QUERIES = {**decontamination.QUERIES, **divergence.QUERIES, **html_text.QUERIES, **licenses.QUERIES, **url_filter.QUERIES, **mixing.QUERIES, **ngram_join.QUERIES, **pii.QUERIES, **quality_model.QUERIES, **spelling.QUERIES, **suffix_dedup.QUERIES, **toxicity.QUERIES, **vector_neighbours.QUERIES}
