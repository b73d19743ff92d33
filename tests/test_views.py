"""Views that Spark computes in another way than their twin."""

import random

import pyarrow as pa

from sightline import views


def plain_luma(text):
    """61 stretches cut out of the text one by one."""
    cut = [int(k * len(text) / 61) for k in range(62)]
    return [sum(views._LETTERS.get(c, 0) for c in text[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def test_luma_of_odd_texts():
    rng = random.Random(5)
    texts = ["", "a", "e" * 60, "aé" * 61, "\U0001f600e" * 500, "\x7f\x00d", *("".join(rng.choices("adeilnorstuxAé \n漢", k=rng.randrange(3000))) for _ in range(300))]
    got = views.luma(pa.array([*texts, None]))
    assert got.to_pylist() == [*map(plain_luma, texts), None]


def test_images_read_a_text_once(spark, sf_dir):
    """Stretches were cut by 122 calls of substr for each text; a query without hashes needs none."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    images = views.view(spark, sf_dir, "images")
    hashed = plan(images.select("dhash", "ahash"))
    assert "substr" not in hashed and hashed.count("ArrowEvalPython") == 1
    assert "EvalPython" not in plan(images.select("filename", "split"))
