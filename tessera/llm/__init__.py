"""Training-data operators: quality, URL filters, deduplication, chat, BPE, HTML, ANN, LM scoring, packing.

Nothing outside this subpackage imports it.
"""
