"""Training-data operators: packing, quality rules, WARC, token counts, mixing, media, classifier, URL filters, PII, near duplicates.

Nothing outside this subpackage imports it; its queries are listed in ``queries.py``.
"""
