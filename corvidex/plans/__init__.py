"""The registered queries with their SQL twins."""

from corvidex.plans import catalog, graphs, lifecycle, linking, masking, relational, retrieval, temporal, texts  # noqa: F401
from corvidex.plans.base import ORACLES, QUERIES


def flagship(spark, sf_dir):
    return QUERIES["bm25_documents"](spark, sf_dir)
