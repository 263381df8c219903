"""Mnemo: conversation-memory analytics and corpus preparation on Spark."""
