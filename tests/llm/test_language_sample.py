from sightline.llm import language_id
from tests.llm.conftest import passage


def test_more_rows_give_no_smaller_fit(frame, monkeypatch):
    sizes = []
    fit = language_id._fit
    monkeypatch.setattr(language_id, "_fit", lambda plus, minus, seed: sizes.append([len(x) for x in (*plus, *minus)]) or fit(plus, minus, seed))
    df = frame([(k, passage(k, 12)) for k in range(1200)])
    df = df.selectExpr(*[c for c in df.columns if c != "lang"], "if(doc_id % 2 = 0, 'en', 'de') lang")
    language_id.train(df, per_language=400)
    assert sizes and all(n == 400 for own in sizes for n in own)
