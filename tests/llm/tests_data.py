"""Edge rows: nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, `Count.x` string, size string, component string"
_LONG = " ".join(f"word{i % 97} and, thing{i % 89}" for i in range(400))


def _row(doc, text, lang="en", source="a"):
    return (doc, text, lang, source, len(text or ""), 1, "x", "y", "z")


EDGE_ROWS = [
    _row(1, None),
    _row(2, ""),
    _row(3, "   \n\t "),
    _row(4, "one"),
    _row(5, "it's a Test, a test of 123 things' sake.", None, None),
    _row(6, "x" * 2000),
    _row(7, _LONG),
    _row(8, _LONG),
    _row(8, _LONG),
    _row(9, _LONG + " more", "fr", "b"),
    _row(10, "naïve café — déjà vu 中文 🙂 é <|endoftext|> <|"),
    _row(-11, "a\nb\na\nb\r\nc"),
    (12, None, None, None, None, None, None, None, None),
]
