"""Texts with every awkward shape, and columns that clash with the operators' own."""

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(9000))
AWKWARD = [
    (1, "Plain words stand here, and here."),
    (2, None),
    (3, ""),
    (4, "   \t\n "),
    (5, "Plain words stand here, and here."),
    (5, "Plain words stand here, and here."),
    (None, "No id at all"),
    (None, None),
    (7, "é日本語 \U0001f600 ﬁ​ x" + "a" * 5000),
    (8, LONG),
    (9, LONG + " end"),
    (10, "<|endoftext|>x<|endoftext|>"),
]
SCHEMA = "doc_id long, text string, n_tokens string, `t` int, `k0` int, b int, w string, `a b` string"
