"""Small documents with every oddity: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node long, n_words string, kept string, shard string"


def rows():
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near an old stone bridge at dawn"
    other = "un petit chat noir dort sur la table pendant que les enfants jouent dans le grand jardin de la maison"
    texts = [
        (1, base), (2, base), (3, base.replace("seven", "eight")), (4, other), (5, None), (6, ""), (7, " \t\n\r "), (8, "word"), (9, "word"),
        (10, "1234 5678 !!"), (11, "long " * 60_000 + "\n" + "x" * 700_000), (12, "a\n\nb\n \na"), (None, base), (None, None), (13, other), (13, other),
        (14, "é" * 40 + " ñ"), (15, "  zero\x00byte \U0001f600"), (16, base + "\n" + other),
    ]
    out = []
    for n, (doc, text) in enumerate(texts):
        lang, source = (None if n % 5 == 4 else "en" if n % 2 else "fr"), (None if n % 7 == 6 else f"s{n % 3}")
        out.append((doc, text, lang, source, None if text is None else len(text), 0.5, "k", 7, "w", "yes", "z"))
    return out


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
