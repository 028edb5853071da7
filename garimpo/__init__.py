"""Posting triage on Spark: filters, labels, dedupe, answers, history, ranking."""
