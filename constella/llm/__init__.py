"""Corpus preparation operators: media, archives, text cleaning, scoring, packing and encoding."""
