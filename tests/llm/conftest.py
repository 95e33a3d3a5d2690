import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, size string, pack string, target string, uid string, part string, kept string"


def rows(seed: int = 3) -> list[tuple]:
    """Texts of all kinds: null, empty, white space, short, repeated, copies, near copies, shared passages, other letters."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeilnorst") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    words = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    long, passage = words(400), words(40)
    near = long.split()
    near[7] = "changed"
    loop = "ab" * 150
    texts = [
        None, "", "   ", "\n\t", "one", "Two words", "ÉTÉ naïve, straße ΑΣ İ", long, long, " ".join(near), long.upper(), words(50) + " " + passage, passage + ". " + words(30), words(20) + "\n" + passage + "\n" + words(9),
        loop, loop + "c", "xyz " * 60, "same line\nsame line\nother\n\n\nsame line", "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0, CC BY-NC 4.0 under the mit license",
        "This work is licensed under the GNU General Public License, version 3.", "a\x1fb c\x85d   e", "<|endoftext|> it's they'll 12,345 #*$%&|<>", "é" * 200, None, "",
    ]
    texts += [words(r.randrange(3, 120)) for _ in range(40)]
    texts += [texts[30], texts[30], texts[31] + " end"]
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    out = [(i, t, r.choice(["en", "de", None, "xx"]), r.choice(["src0", "src0", "src1", "é", None]), len(t or ""), 5, "x", "y", "z", "t", "u", "p", "k") for i, t in zip(ids, texts, strict=True)]
    return out


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, fixture_rows):
    """Null identifiers, and rows that are there twice."""
    some = fixture_rows[4:12]
    return spark.createDataFrame([*some, *some[:3], (None, *some[5][1:]), (None, *some[5][1:]), (None, None, *some[0][2:])], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
