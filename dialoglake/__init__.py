"""Conversation data at scale: corpus curation, batch retrieval, profiles, analytics and evaluation on Spark."""
