from collections import Counter

from sightline.llm import simhash
from tests.llm.conftest import passage


def test_repeated_ids_equal_rows_and_nulls(frame):
    a, b, c = passage(1, 80), passage(2, 80), passage(3, 80)
    df = frame([(3, a), (7, a), (7, b), (3, a), (None, c), (None, c), (9, None), (9, ""), (8, "")])
    assert Counter((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(df).collect()) == Counter([(3, a), (7, b), (None, c), (8, "")])
