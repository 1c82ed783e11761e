import numpy as np
import pytest

from skerry.llm import markup as M
from skerry.llm import markup_train as train
from skerry.llm.markup import clean_markup

KIND = "chunk_ord bigint, text string, n_marked string"
PLAIN = "The old lighthouse keeper walked down to the harbour every single morning before dawn"


def read(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], KIND)
    return {r["chunk_ord"]: r for r in clean_markup(df).collect()}


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [
        ("<p>He <b>ran</b> &amp; fell.</p>", "He ran & fell."),
        ("He **ran** to `the dam` and ~~hid~~ [there](http://x.y/z).", "He ran to the dam and hid there."),
        ("He met [[Anna (Earth-2)|Anna]] and ''the'' '''crew'''.", "He met Anna and the crew."),
        ("He \\textit{ran} to the caf\\'{e} with \\href{http://x}{Anna} today.", "He ran to the cafe\u0301 with Anna today."),
        ('He ran<ref name="x">Vol. 1</ref> home<sup class="ref"><a href="#c">3</a></sup>.', "He ran home ."),
        ("He ran~\\cite{anna2001} home\\marginpar{After Anna, 2007.} and slept.", "He ran home and slept."),
    ],
)
def test_inline_markup_goes(spark, dirty, clean):
    row = read(spark, [f"[Title]\n{dirty}\n{PLAIN}."])[0]
    assert row["has_markup"] and row["clean_text"].split("\n")[1] == clean and row["clean_text"].endswith(f"{PLAIN}.")


def test_structure_stays(spark):
    text = f"[Title]\n## Early Life\n{PLAIN}.\n\n* [[One]]\n* [[Two]]\n\n```python\nfor x in y:\n    z(x)\n```\n\n$$ a = 3 \\cdot \\sqrt{{b}} $$"
    row = read(spark, [text])[0]
    said = [(b["role"], b["text"]) for b in row["blocks"]]
    assert ("heading", "Early Life") in said and ("list", "- One") in said and ("code", "    z(x)") in said
    assert "\n\nEarly" not in row["clean_text"] and ".\n\n- One\n- Two\n\nfor x in y:\n    z(x)\n\na = 3" in row["clean_text"]
    assert ("formula", "a = 3 \\cdot \\sqrt{b}") in said


def test_everyday_signs_are_not_markup(spark):
    texts = [
        "Lunch was $12, dinner $40.", "Keep the heat < 80 and the load > 3.", "The final was 2 = 2 [after extra time] as ever.", "a board of 8 * 8 squares", "See D:\\music\\track_9 for it.",
        "Rated A+ | by Lee :-)", "- item one\n- item two", "The shop Reed & Sons closed.", "about ~50 people {perhaps more}",
    ]
    got = read(spark, [f"[Title] — Section\n{PLAIN}.\n{t}" for t in texts])
    assert [t for i, t in enumerate(texts) if got[i]["has_markup"]] == []
    assert all(got[i]["clean_text"].endswith(t) for i, t in enumerate(texts))


def test_the_network_alone_decides(spark, tmp_path):
    silent = {k: np.zeros_like(v) for k, v in M.load().items()} | {"bias": np.full(8, -9.0, np.float32)}
    np.savez(tmp_path / "w.npz", **silent)
    df = spark.createDataFrame([(1, f"{PLAIN}.\n<b>x</b>\n## y", "x")], KIND)
    assert not clean_markup(df, weights=str(tmp_path / "w.npz")).first()["has_markup"] and clean_markup(df).first()["has_markup"]


def test_no_bound_on_nesting_or_length(spark):
    deep = "".join(f"<div class='a{i}'>\n" for i in range(20)) + PLAIN + "\n" + "</div>\n" * 20
    long = PLAIN + ". " + "So it went on and on. " * 30 + "$" + " + ".join("abcdefghijklmnopqrstuvwxyz" * 3) + "$ " + "And on. " * 30
    got = read(spark, [deep, long, PLAIN + " " + "word " * 20_000 + "<b>x</b>"])
    assert [got[i]["has_markup"] for i in range(3)] == [True] * 3
    assert "<div" not in got[0]["clean_text"] and "$" not in got[1]["clean_text"]
    path = M.leaves(deep)[20]
    assert path.depth == 20 and path.path != M.leaves(deep.split("\n", 1)[1])[19].path


def test_null_empty_long_and_repeated(spark):
    got = read(spark, [None, "", " \n", (PLAIN + ". <b>x</b>\n") * 4000, "<b>x</b>", "<b>x</b>"])
    assert got[0]["clean_text"] is None and not got[0]["has_markup"] and got[1]["clean_text"] == "" and got[2]["clean_text"] == " \n"
    assert got[3]["n_marked"] == 4000 and "<b>" not in got[3]["clean_text"] and got[4]["clean_text"] == got[5]["clean_text"]
    assert clean_markup(spark.createDataFrame([], KIND)).count() == 0


def test_batching_does_not_matter():
    weights = M.load()
    texts = ["# A\n" + PLAIN, "<p>x</p>", "\n".join(["* a", "b"] * 30), PLAIN]
    found = [M.leaves(t) for t in texts]
    both = M.label(weights, M.embed(weights, M.Described([x for f in found for x in f])), np.array([len(f) for f in found]))[1]
    alone = np.concatenate([M.label(weights, M.embed(weights, M.Described(f)), np.array([len(f)]))[1] for f in found])
    assert np.allclose(both, alone, atol=1e-4)


def test_held_out_accuracy_and_training():
    rng = np.random.default_rng(99)
    vocabulary = PLAIN.lower().split() + "river stone captain winter engine council street window letter garden".split()
    lines = [" ".join(rng.choice(vocabulary, rng.integers(6, 18))).capitalize() + "." for _ in range(500)]
    maker = train.Maker(99, lines)
    weights = M.load()
    right = total = 0
    for _ in range(300):
        text, labels = maker.text()
        found = M.leaves(text)
        assert len(found) == len(labels)
        doubt = M.label(weights, M.embed(weights, M.Described(found)), np.array([len(found)]))[1]
        right += int(((doubt > 0.5) == (np.array([m for _, m in labels]) > 0)).sum())
        total += len(labels)
    assert right / total > 0.97
    tiny = train.train([maker.text() for _ in range(60)], epochs=1)
    assert set(tiny) == set(weights)
