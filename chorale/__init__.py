"""Reconciles several partial logs of one conversation, as DataFrame plans for a Spark cluster."""
