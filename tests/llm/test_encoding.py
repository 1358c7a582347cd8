import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom.llm import encoding, queries

pytestmark = pytest.mark.skipif(not Path(encoding.VOCABULARIES, "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def whole():
    """The public encoder over whole texts."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(encoding.VOCABULARIES, "byte_bpe_50k.tiktoken").open("rb"))}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(8)
    signs = list("aZ é'ſ\u00a0\u2003\u3000\n\t\r.,<|>_-0٣Ⅷ𠀀🚀👩‍💻ñ́ﬁ中の\x00\x85\ufeff")
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    return ["", None, " ", "  a", "<|endoftext|> it's WE'LL", "x" * 20_000, "\n" * 5000 + "a", "same", "same", *made]


@pytest.mark.parametrize("frequent", [100_000, 20, 0])
def test_ids_equal_the_public_encoder(spark, whole, frequent):
    rows = [*enumerate(texts()), (None, "a key that is null"), (3, "a key that is repeated")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "word": F.lit("w"), "key": F.lit("k")})
    encoded = encoding.encode(df, frequent_words=frequent)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.ids) for r in encoded.collect()) == order((i, whole.encode_ordinary(t) if t else []) for i, t in rows)
    unique = encoded.filter("doc_id is null or doc_id <> 3")
    assert {r.doc_id: r.text for r in encoding.decode(unique).collect()} == {i: t or "" for i, t in rows if i != 3}


def test_long_words_are_never_held_by_every_task(spark, whole):
    rows = [(i, "x" * 300 + " and " + "y" * i) for i in range(300)]
    got = encoding.encode(spark.createDataFrame(rows, "doc_id long, text string"), frequent_words=10)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: whole.encode_ordinary(t) for i, t in rows}


def test_empty_table(spark):
    assert encoding.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_data(spark, sf, whole, same_rows):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in queries.p6_ids(spark, sf).collect()} == {i: whole.encode_ordinary(t) if t else [] for i, t in docs.items()}
    same_rows(queries.QUERIES["p6_round_trip"], queries.ORACLE["p6_round_trip"])
