"""Pluggable providers: text models, embedders, entity extractors, tokenizers."""
