"""Operators on text corpora: token ids, packing into containers, subjects."""
