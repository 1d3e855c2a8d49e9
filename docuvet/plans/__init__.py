"""Registered queries by topic."""

TOPICS = (
    "risk_queries", "document_queries", "mrz_queries", "image_queries", "liveness_queries", "screening_queries", "stream_queries", "learning_queries",
)
