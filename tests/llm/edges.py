"""Rows with nulls, empty and long texts, ties and repeats."""

#: Names that operators use inside, as extra columns of the input.
CLASHING = "id n key row count position size kept label fingerprint part before _id _row _key _text _all _hash _n _p source_key place rate copies words paragraph s shard tie d0 conv piece body host url2 _digest least best".split()
LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
EDGE = [
    (5, "The same  text of several words\nhere", "en", "a"), (3, "The same text of several words here", "en", "b"), (3, "The same text of several words here", "en", "b"), (9, None, None, None), (8, "", "xx", ""), (7, " \t\n ", "en", "a"),
    (None, "The same text of several words here", "en", None), (11, LONG, "de", "a"), (12, LONG + " end", "de", "a"), (13, "one", "en", "b"), (14, "ONE", "fr", "b"), (15, "a b", "en", "c"), (16, "x" * 50_000, "en", "c"), (17, "Ünïcode ✓ 漢字   </s>", "en", "c"), (None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
