"""Rows and comparisons shared by the tests of this folder."""

SF001 = "/root/testdata/sf0.001"

#: nulls, empty and odd texts, ties, repeated rows, a long text, a hot group
ODD = (
    [
        (1, None, "en", "s", 0),
        (2, "", None, "s", 0),
        (3, " \t\n", "en", None, None),
        (4, "Hello  World", "en", "s", 1),
        (5, "Hello World", "en", "s", 1),
        (5, "Hello World", "en", "s", 1),
        (None, "Hello World ", "en", "s", 1),
        (None, None, None, None, None),
        (8, "mail a.b@c.de, 10.0.0.1 and 999.1.1.1; card 4111 1111 1111 1111 tel +49 (30) 123-4567", "de", "s", 1),
        (9, "x@y@z.w @q.r@s.t 1.2.3.4.5.6.7.8 iban DE89 3704 0044 0532 0130 00 <|endoftext|> é中\U0001f600  ", "de", "s", 1),
        (10, "a" * 5000 + "@" + "9" * 6000 + ". " + "1" * 4500, "en", "s", 1),
    ]
    + [(100 + i, "the same words are here again and again for all of these rows " * 2, "en", "hot", 1) for i in range(30)]
    + [(200 + i, "one two three four five six seven eight nine ten eleven twelve thirteen " + f"tail{i % 7} " * (i % 5), "fr", "hot", 1) for i in range(30)]
    + [(300, "word%d " * 1 % 1 + " ".join(f"w{i % 977}" for i in range(30000)), "es", "s", 1)]
)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
