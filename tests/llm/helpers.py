DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"

ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, None),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, "x"),
    (4, "  \n\t ", "en", None, 5, "x"),
    (5, "word " * 9000, "en", "a", 45000, "x"),
    (6, "the quick brown fox jumps over the lazy dog", "en", "b", 43, None),
    (7, "ÉCOLE déjà 日本語 🎉 x", None, "b", 20, None),
    (None, "a row without an id", "en", "b", 19, None),
    (8, "the quick brown fox jumps over the lazy cat", "en", "b", 43, None),
    (8, "the quick brown fox jumps over the lazy cat", "en", "b", 43, None),
]


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), None)
