"""Small tables with everything that a row can have wrong, as a folder of Parquet."""

import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside.
CLASHING = ["key", "row", "fp", "words", "pii", "hub", "shard", "d_text", "n_words", "matches", "lang_pred", "x"]
FRENCH = "le chat est dans la maison et il ne veut pas sortir car il pleut beaucoup aujourd'hui mon ami".split()
ENGLISH = "the cat sat on the mat and would not leave the house because it was raining very hard today".split()
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def make_documents() -> list[tuple]:
    rng = random.Random(7)

    def prose(words: list[str], n: int) -> str:
        return " ".join(rng.choice(words) + str(rng.randint(0, 9)) * (rng.random() < 0.2) for _ in range(n))

    rows = [(i, prose(ENGLISH if i % 2 else FRENCH, 60), "en" if i % 2 else "fr", f"s{i % 3}", i) for i in range(60)]
    hot = prose(ENGLISH, 80)
    rows += [(100 + i, hot, "en", "hot", None) for i in range(40)]  # copies: a third of all
    near = prose(ENGLISH, 400).split()
    for i in range(8):
        changed = list(near)
        changed[50 * i] = f"word{i}"
        rows.append((200 + i, " ".join(changed), "en", None, 5))
    rows += [
        (300, None, None, None, None),
        (301, "", "en", "", 0),
        (302, "   \n\t ", None, "s", 3),
        (303, "12345 67.8 !!", "en", "s", 1),
        (None, "a text without an id, but with words enough for a window or two of them", "en", "s", 1),
        (None, None, None, None, None),
        (304, prose(FRENCH, 30_000), "fr", "long", 1),
        (305, f"before {ITEM.upper()}! after. {ITEM}", "en", "s", 1),
        (306, "short item", "en", "s", 1),
        (307, "a.b+c@mail.example.org, 1.2.3.4 256.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +49 (30) 1234567 +12", "en", "s", 1),
        (308, "IBAN: DE89 3704 0044 0532 0130 00. my social security number is 123-45-6789; not 123-45-6780 there", "en", "s", 1),
        (309, "Used under the MIT License; apache license, version 2.0. CC BY-NC-SA 4.0 cc-by-nc cc by nc", "en", "s", 1),
        (310, "\U0001f600 mail \U0001f600 x@y.zz éЖ中 x@y.zz", "xx", "s", 1),
        (311, "ab" * 300, "en", "s", 1),
        (312, "\x00\x1c" * 120 + "<|endoftext|>", "en", "s", 1),
    ]
    rows += [rows[3], rows[3], rows[100]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def fixture_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(make_documents(), DOCUMENTS)
    docs = docs.withColumns({c: F.lit("clash") for c in CLASHING})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, ITEM), (2, "short item"), (3, None), (4, ""), (None, "enough for a window or two of them"), (1, "of them"),
             (5, "no such words anywhere at all in the documents of this test")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, fixture_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{fixture_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder
