"""Texts that every operator must take."""

EDGES = [None, "", " ", "\n\n", "a", "é" * 300, "word " * 12000, "x" * 30000, "same text here, twice over\nsecond line of the same text", "same text here, twice over\nsecond line of the same text", "mail a.b@c.example.org or +1 (523) 555-1055 or 10.0.0.1", "\x00\x01 \t odd ▁ bytes"]
