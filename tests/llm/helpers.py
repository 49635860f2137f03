import duckdb

TABLES = "documents embeddings benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def same(df, sql, sf=None, **frames):
    """Rows of ``df`` equal those of the SQL over the tables of ``sf`` or over given pandas frames."""
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        elif sf:
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert ours == theirs


#: Rows with every oddity at once: nulls in each column, empty and long texts, ties, repeated rows, clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, taken long"
ODD = [
    (1, None, "en", "a", None, "x", 1, 1),
    (2, "", None, None, 0, None, None, None),
    (3, " \n\t ", "en", "a", 4, "x", 1, 1),
    (4, "one two three four five six seven eight nine ten\n" * 30, "en", "a", 1500, "x", 1, 1),
    (5, "one two three four five six seven eight nine ten\n" * 30, "de", "b", 1500, "x", 1, 1),
    (5, "one two three four five six seven eight nine ten\n" * 30, "de", "b", 1500, "x", 1, 1),
    (6, "word " * 60_000, "en", "a", 300_000, "x", 1, 1),
    (7, "ß" * 50_000, "de", "b", 50_000, "x", 1, 1),
    (None, "no key here but a text of some length anyhow", "en", "c", 44, "x", 1, 1),
    (8, "a", "en", "c", 1, "x", 1, 1),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def thue_morse(size: int) -> tuple[str, str]:
    """Two words whose sums of letters times powers are alike modulo 2**64, for any odd base, from 1024 letters on."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
