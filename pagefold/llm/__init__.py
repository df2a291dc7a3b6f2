"""Training-data operators: chat formatting, PII, similarity joins, toxicity, decontamination, BPE, licences,
media chunks, token files and HTML extraction.  Nothing outside this subpackage imports it."""
