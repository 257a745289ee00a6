"""Training-data operators: licences, chat, pieces, personal data, duplicates, toxicity, leaks, quality, URLs, language models.

Nothing else in the library imports this subpackage.
"""
