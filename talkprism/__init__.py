"""Conversation evidence analytics and corpus operators on PySpark."""
