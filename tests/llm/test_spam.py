import random

import pytest

from tidewater.llm import spam

PROSE = "The write buffer rejected {n} rows with a timestamp in the future, so the next flush took {m} minutes. Before you restart it, make sure that no other change is running against the {w}."
LOG = "12:{n:02d}:{m:02d}.735 INFO [{w}-auth] retrying shipment after {n} ms, attempt {m}"
WORDS = "journal compactor index shard gateway archive platform bundle metric server cluster".split()


def fill(text, rnd):
    return text.format(n=rnd.randrange(60), m=rnd.randrange(60), w=rnd.choice(WORDS))


def page(kind, seed, lines=12):
    rnd = random.Random(f"{kind}{seed}")
    w = [" ".join(rnd.sample(WORDS, 2)) for _ in range(3)]
    one = {
        "prose": lambda: fill(PROSE, rnd), "log": lambda: fill(LOG, rnd), "settings": lambda: f"{rnd.choice(WORDS)}.limit = {rnd.randrange(99)}",
        "keywords": lambda: " ★ ".join(rnd.choice(w) for _ in range(12)), "links": lambda: f"https://{rnd.choice(WORDS)}{rnd.randrange(99)}.example/{rnd.choice(WORDS)}/{rnd.randrange(999)}",
        "anchors": lambda: f'<a href="www.{rnd.choice(WORDS)}.example/x?id={rnd.randrange(999)}">{rnd.choice(w)}</a>', "hashtags": lambda: " ".join(f"#{rnd.choice(WORDS).title()}{rnd.randrange(30)}" for _ in range(8)),
        "products": lambda: f"{rnd.choice(WORDS).title()} Pro bundle {rnd.choice(w)} {rnd.randrange(99)}.99", "cited": lambda: fill(PROSE, rnd) + f" See https://wiki.{rnd.choice(WORDS)}.example/draft/{rnd.randrange(999)}.",
    }[kind]
    return "\n".join(one() for _ in range(lines))


SPAM, HAM = ("keywords", "links", "anchors", "hashtags", "products"), ("prose", "log", "settings", "cited")


@pytest.fixture(scope="module")
def model():
    texts = [page(k, s) for s in range(25) for k in (*SPAM, *HAM, "prose", "prose")]
    return spam.LineModel().fit(texts, [None] * len(texts))


@pytest.mark.parametrize("kind", [*SPAM, *HAM])
def test_held_out_pages(model, kind):
    shares = [model.list_share(page(kind, 1_000 + s)) for s in range(20)]
    right = sum((x > 0.5) == (kind in SPAM) for x in shares)
    assert right >= 19


def test_share_of_a_mixed_page(model):
    mostly = page("prose", 5, 10) + "\n" + page("links", 5, 3)
    hardly = page("prose", 6, 2) + "\n" + page("links", 6, 30)
    assert model.list_share(mostly) < 0.4 and model.list_share(hardly) > 0.6
    assert model.list_share(page("prose", 7) + "\n\nTags: shipment, sensor, badge") < 0.2


def test_scraps_and_blanks(model):
    for t in (None, "", "   \n\t ", "ok", "done, thanks", "n/a", "# heading\n1. part", "​​"):
        assert model.list_share(t) == 0.0


def test_parts_lose_nothing():
    rnd = random.Random(2)
    for text in (page("keywords", 1), " ".join(page("prose", s) for s in range(3)), "原因。" * 400, "x" * 200_000, " ".join(rnd.choice(WORDS) for _ in range(5_000))):
        assert "".join("".join(spam.split_parts(text)).split()) == "".join(text.split())
        assert all(len(x.split()) <= spam.LONGEST_PART for x in spam.split_parts(text))


def test_documents(spark, model):
    rows = [(1, page("links", 3), "k", "t"), (2, page("prose", 3), "k", "t"), (3, None, "k", "t"), (4, "", "k", "t"), (5, page("products", 9, 3_000), "k", "t"), (None, page("hashtags", 1), "k", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, t string")
    got = {r.doc_id: r.flagged for r in spam.flag(df, model).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, None: True}
    assert spam.flag(df.where("false"), model).count() == 0


def test_training_with_labels_nulls_and_conflicts(spark):
    docs = [(i, page((*SPAM, *HAM)[i % 9], i)) for i in range(120)] + [(500, None), (None, "no id")]
    labels = [(i, "r", 1 if i % 9 < 5 else 0) for i in range(0, 120, 2)] + [(0, "s", None), (2, "s", 0), (999, "r", 1), (None, "r", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = spam.train(d, spark.createDataFrame(labels, "doc_id long, annotator string, spam int"))
    assert m.threshold == spam.THRESHOLD  # too few labels to move it
    assert m.list_share(page("links", 77)) > 0.5 > m.list_share(page("prose", 77))
    spam.train(d.where("false"), None)
