"""Training-data operators: near duplicates, tokens, urls, html, language, personal data, quality, toxicity, leaks.

Nothing else in the library imports this subpackage.
"""
