import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import tokens as k

encode = k.encoder(k.vocabulary_path()).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80), st.integers(1, 9))
def test_tree_is_as_whole_text(text, leaf):
    text = text.encode("utf-8", "replace").decode("utf-8")
    assert k.encode_tree(text, encode, leaf).ids == encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 1\n\t'.,lstrevm  <|>é日́²"), max_size=80), st.integers(1, 9))
def test_tree_is_as_whole_text_at_hard_borders(text, leaf):
    assert k.encode_tree(text, encode, leaf).ids == encode(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab 1\n'.s"), max_size=20), st.text(st.sampled_from("ab 1\n'.s"), max_size=20), st.text(st.sampled_from("ab 1\n'.s"), max_size=20))
def test_join_is_associative(a, b, c):
    x, y, z = (k.Encoded(t, encode(t)) for t in (a, b, c))
    assert k.join(k.join(x, y, encode), z, encode).ids == k.join(x, k.join(y, z, encode), encode).ids


def test_very_long_and_monotonous_texts():
    rng = random.Random(1)
    for text in ("word " * 50_000, " " * 30_000, "x" * 30_000, "\n" * 9_000 + "a", "".join(rng.choices("ab \n", k=60_000))):
        assert k.encode_tree(text, encode).ids == encode(text)


def test_operator_and_round_trip(spark):
    texts = [None, "", " ", "<|endoftext|> café 日本 😀", "a" * 5000, "same", "same"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    rows = {r["doc_id"]: r["ids"] for r in k.encode_texts(df).collect()}
    assert rows[0] == rows[1] == [] and rows[3] == encode(texts[3]) and 50256 not in rows[3] and rows[5] == rows[6]
    back = {r["doc_id"]: r["text"] for r in k.decode_ids(k.encode_texts(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in k.encode_texts(df, counts_only=True).collect()} == {i: len(x) for i, x in rows.items()}
    assert k.encode_texts(df.limit(0)).count() == 0
