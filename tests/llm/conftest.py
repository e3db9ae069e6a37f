import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of texts, or of (doc_id, text) pairs, over several partitions."""

    def make(texts, extra=()):
        rows = [t if isinstance(t, tuple) else (n, t) for n, t in enumerate(texts)]
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        for name in extra:
            df = df.withColumn(name, df.n_chars * 7)
        return df

    return make


#: Texts that operators must take without falling over.
ODD = [
    None,
    "",
    " ",
    "\n",
    "\n\n \t\n",
    "a",
    "one two",
    "  two  spaces ",
    "tabs\tand\x0bfeeds\x0c\r\n",
    "nul \0 inside",
    "<|endoftext|> <s> </s>",
    "ünïcödé ẞ İ ſ K ﬁ ½ ² 一二 한국 🙂",
    "▁ literal ▁▁ marks",
    "exotic  white\x85space\x1c",
    "don't 's 'll WE'RE",
    "x" * 3000,
    ("word " * 2000).strip(),
    "same line\n" * 30,
    "one two",
    "password: hunter22 AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2,
]
#: Column names that operators use inside.
CLASHES = ("_doc", "_key", "_cuts", "words", "body", "shard", "slot", "kept", "component_id", "length", "path", "n")
