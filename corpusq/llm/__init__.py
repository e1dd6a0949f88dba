"""Training-data preparation operators (URL filters, de-duplication, tokens, mixing, ...)."""
