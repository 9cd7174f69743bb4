"""quernel: document analytics, retrieval and corpus governance on Spark."""
