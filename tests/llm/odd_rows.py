"""Rows that every operator must take."""

#: Nulls in any column, empty and blank texts, repeated rows, equal texts, letters of several bytes, a long text.
ODD = [
    (1, "The first document has a few words in it, and it ends here. It really does."),
    (1, "The first document has a few words in it, and it ends here. It really does."),
    (2, "The first document has a few words in it, and it ends here. It really does."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "A text without an id."),
    (None, None),
    (6, "Größe, façade — 中文 字 and 😀 emoji; don't we'll <|endoftext|> 12 345."),
    (7, "one"),
    (8, "two words"),
    (9, "...!!!???"),
    (10, "long word " * 3000 + "x" * 5000),
    (11, "Ａ b c\u0085d"),
]
